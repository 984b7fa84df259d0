"""Column roles derived from the schema, and the NaN -> NULL normalisation.

Every operator routes columns by role: ``numeric`` columns get moments,
quantiles and correlations; ``categorical`` (string) columns get value
counts; ``boolean`` / ``datetime`` / ``other`` only take part in the
whole-table checks (missing, duplicates, constants).  Roles come from the
schema alone, so deciding them costs no data pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def role_of(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "other"


@dataclass(frozen=True)
class ColumnRoles:
    columns: tuple[str, ...]
    roles: dict = field(hash=False)

    @classmethod
    def of(cls, df: DataFrame) -> "ColumnRoles":
        return cls(tuple(df.columns), {f.name: role_of(f.dataType) for f in df.schema.fields})

    def by_role(self, role: str) -> list[str]:
        return [c for c in self.columns if self.roles[c] == role]

    @property
    def numeric(self) -> list[str]:
        return self.by_role("numeric")

    @property
    def categorical(self) -> list[str]:
        return self.by_role("categorical")

    @property
    def datetime(self) -> list[str]:
        return self.by_role("datetime")

    @property
    def boolean(self) -> list[str]:
        return self.by_role("boolean")

    @property
    def other(self) -> list[str]:
        return self.by_role("other")


def normalize(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in float columns and decimals become doubles, once,
    so that every later aggregate sees a single notion of "missing".
    A pure projection: it fuses into the scan's codegen stage."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(c.cast("double").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in float columns; every type stays as it is.  For operators
    that give rows back (cleaning) or compare whole rows, where a decimal must not
    lose digits."""
    return df.select(*[F.nanvl(qcol(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else qcol(f.name) for f in df.schema.fields])


def qcol(name: str):
    """Column reference that survives dots and spaces in names."""
    return F.col("`" + name.replace("`", "``") + "`")
