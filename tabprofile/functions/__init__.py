"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from tabprofile.functions.exprs import (  # noqa: F401
    balance_label,
    corr_strength,
    kurtosis_unbiased,
    long_rows,
    safe_corr,
    skewness_unbiased,
)
