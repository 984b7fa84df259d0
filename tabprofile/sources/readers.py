"""Sources (S1-S3, S6, D-d).

CSV: read every column as text, turn the NA tokens into NULL, then decide
each column's type with ONE aggregate pass that counts, per column, how many
present values survive ``try_cast`` to bigint / double / boolean.  The
built-in ``inferSchema`` takes a single null token and reads a column with
``NA`` as text, which is why it is not used.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprofile.roles import qcol

# Fixed values that must equal the reference's: the default missing-value
# tokens of the CSV reader it relies on, in natural order.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SUPPORTED = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".orc": "orc"}


# a plain decimal number; Spark's own cast would also take codes such as 1D or 2F
NUMBER = r"\A\s*[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*\z"


def _try(c, t):
    cast = F.expr("try_cast(`" + c.replace("`", "``") + f"` AS {t})")
    return F.when(qcol(c).rlike(NUMBER), cast)


def as_number(df: DataFrame, col: str):
    """``col`` as double: text that is no plain decimal number is NULL."""
    if df.schema[col].dataType.simpleString() == "string":
        return _try(col, "DOUBLE")
    return F.expr("try_cast(`" + col.replace("`", "``") + "` AS DOUBLE)")


# a date in text starts with year and month, parted by a hyphen; a bare number such as 2020 or
# 90210 would pass Spark's cast, too
DATE = r"\A\s*[+-]?[0-9]{4,6}-[0-9]{1,2}(?:\D|\z)"


def infer_types(df: DataFrame) -> DataFrame:
    """D-d / S1: ``(column_name, present, as_long, as_double, as_boolean, inferred)``
    for string columns; ``inferred`` is the narrowest of bigint, double,
    boolean that every present value parses as, else string."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, present long, as_long long, as_double long, as_boolean long, inferred string")
    aggs, structs = [], []
    for i, c in enumerate(cols):
        v = qcol(c)
        aggs += [F.count(v).alias(f"p{i}"), F.count(_try(c, "BIGINT")).alias(f"l{i}"),
                 F.count(_try(c, "DOUBLE")).alias(f"d{i}"),
                 F.count(F.when(F.lower(F.trim(v)).isin("true", "false"), v)).alias(f"b{i}")]
        p, l, d, b = (F.col(f"{k}{i}") for k in "pldb")
        inferred = (F.when(p == 0, "string").when(l == p, "bigint").when(d == p, "double")
                    .when(b == p, "boolean").otherwise("string"))
        structs.append(F.struct(F.lit(c).alias("column_name"), p.alias("present"), l.alias("as_long"),
                                d.alias("as_double"), b.alias("as_boolean"), inferred.alias("inferred")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def infer_kinds(df: DataFrame) -> DataFrame:
    """D-d: ``(column_name, kind)``.  A string column is ``datetime`` if every present value
    is written as a date and parses as a timestamp, ``category`` if it has fewer distinct values than half its rows,
    else ``object``; other columns keep their type's name.  A column without values is
    ``object``.  Values are counted by two hashes, so no text is shuffled."""
    spark = df.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = [c for c, t in kinds.items() if t == "string"]
    if cols:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(cols):
            aggs += [F.count(qcol(c)).alias(f"p{i}"),
                     F.count(F.when(qcol(c).rlike(DATE), F.expr("try_cast(`" + c.replace("`", "``") + "` AS TIMESTAMP)"))).alias(f"t{i}")]
        facts = df.agg(*aggs).first()
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.when(qcol(c).isNotNull(), F.xxhash64(qcol(c))).alias("a"),
                                   F.xxhash64(F.lit("second"), qcol(c)).alias("b")) for i, c in enumerate(cols)])
        values = df.select(F.inline(cells)).where(F.col("a").isNotNull()).groupBy("i", "a", "b").agg(F.lit(1).alias("one"))
        levels = {r["i"]: r["n"] for r in values.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}  # O(columns)
        for i, c in enumerate(cols):
            present = facts[f"p{i}"]
            kinds[c] = ("object" if not present else "datetime" if facts[f"t{i}"] == present
                        else "category" if levels[i] / facts["rows"] < 0.5 else "object")
    return spark.createDataFrame(list(kinds.items()), "column_name string, kind string")


# a line that ends inside a quoted field: its last field opens with a quote that nothing closes
OPEN_FIELD = r'^(?:(?:[^",][^,]*|"(?:[^"]|"")*"[^,]*|),)*"(?:[^"]|"")*$'


def read_csv(spark: SparkSession, path: str, na_tokens: list[str] | None = None, infer: bool = True,
             multiline: bool = False, check_lines: bool = True) -> DataFrame:
    """CSV with a header; NA tokens -> NULL; types from one counting pass.

    A quote inside a quoted field is doubled.  Fields with line breaks need ``multiline``;
    then a file is one split, so write such data as many files.  Without it a scan of
    the lines (``check_lines``) raises if one ends inside a quoted field, as its row would
    be cut in two."""
    if not multiline and check_lines:
        lines = spark.read.text(path).where(((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1)
                                            & F.col("value").rlike(OPEN_FIELD))
        if not lines.isEmpty():
            raise ValueError(f"{path} has line breaks inside quoted fields; read it with multiline=True")
    raw = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .option("escape", '"').option("multiLine", multiline).option("emptyValue", "").option("mode", "PERMISSIVE").csv(path)
    toks = NA_TOKENS if na_tokens is None else na_tokens
    clean = raw.select(*[F.when(qcol(c).isin(toks), F.lit(None)).otherwise(qcol(c)).alias(c) for c in raw.columns])
    if not infer:
        return clean
    plan = {r["column_name"]: r["inferred"] for r in infer_types(clean).collect()}  # O(columns)
    out = []
    for c in clean.columns:
        t = plan.get(c, "string")
        if t == "boolean":
            out.append(F.when(F.lower(F.trim(qcol(c))) == "true", True)
                       .when(F.lower(F.trim(qcol(c))) == "false", False).alias(c))
        elif t in ("bigint", "double"):
            out.append(_try(c, t.upper()).alias(c))
        else:
            out.append(qcol(c))
    return clean.select(*out)


def load(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Dispatch on ``fmt`` or the path suffix; unsupported -> error."""
    if fmt is None:
        suffix = os.path.splitext(path.rstrip("/"))[1].lower()
        fmt = SUPPORTED.get(suffix)
        if fmt is None:
            raise ValueError(f"Unsupported format: {suffix or '(none)'} "
                             f"(use one of {', '.join(sorted(SUPPORTED))})")
    if fmt == "csv":
        return read_csv(spark, path, **options)
    return spark.read.format(fmt).options(**options).load(path)
