"""D-e: category types: dictionary encoding of text columns with few distinct values.

A column under ``max_share`` distinct values a row becomes whole numbers: the place of the value
among the column's sorted distinct values (``ranks.positions``), so equal data get equal codes
whatever the partitioning.  The levels are a table of their own; coding and decoding are joins
on it, which Spark broadcasts if small and can split if a value is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.operators.ranks import positions
from tabprofile.roles import qcol
from tabprofile.sources.sinks import shared_table

CODE_BYTES = 4


@dataclass
class Encoded:
    table: DataFrame              # the columns of the source, chosen ones as int codes
    levels: dict[str, DataFrame]  # (code, value) of each chosen column
    columns: list[str]

    def decode(self) -> DataFrame:
        """The source again."""
        return _joined(self.table, {c: (t, "code", "value") for c, t in self.levels.items()}, self.columns)


def _joined(df: DataFrame, levels: dict, names: list[str]) -> DataFrame:
    """``df`` with each column of ``levels`` looked up in its table: (table, from, to)."""
    out = df.toDF(*[f"c{i}" for i in range(len(names))])
    for i, c in enumerate(names):
        if c in levels:
            table, key, to = levels[c]
            side = table.select(F.col(key).alias("k"), F.col(to).alias("v"))
            out = out.join(side, F.col(f"c{i}") == F.col("k"), "left").withColumn(f"c{i}", F.col("v")).drop("k", "v")
    return out.toDF(*names)


def category_columns(df: DataFrame, max_share: float = 0.5) -> list[str]:
    """String columns with values and fewer distinct ones than ``max_share`` of the rows."""
    from tabprofile.sources.readers import infer_kinds
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if max_share == 0.5:
        kinds = {r["column_name"]: r["kind"] for r in infer_kinds(df.select(*[qcol(c) for c in cols])).collect()} if cols else {}
        return [c for c in cols if kinds[c] == "category"]
    n = df.count()
    return [c for c in cols if 0 < df.where(qcol(c).isNotNull()).groupBy(F.xxhash64(qcol(c))).count().count() < max_share * n]


def encode_categories(df: DataFrame, cols: list[str] | None = None) -> Encoded:
    """``df`` with ``cols`` (default: :func:`category_columns`) as codes.  A missing value stays NULL."""
    cols = category_columns(df) if cols is None else cols
    levels = {}
    for c in cols:
        values = df.select(qcol(c).alias("value")).where("value is not null").distinct()
        levels[c] = shared_table(positions(values, [F.col("value")], name="code").select(F.col("code").cast("int").alias("code"), "value"), "levels")
    return Encoded(_joined(df, {c: (t, "value", "code") for c, t in levels.items()}, df.columns), levels, df.columns)


def saved_bytes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, levels, text_bytes, encoded_bytes, saved_bytes)``: a code has four bytes, a level its
    text once."""
    cols = category_columns(df) if cols is None else cols
    out = None
    for c in cols:
        counts = df.where(qcol(c).isNotNull()).groupBy(qcol(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        size = F.octet_length("value").cast("long")
        one = counts.agg(F.count(F.lit(1)).alias("levels"), F.coalesce(F.sum(size * F.col("n")), F.lit(0)).alias("text_bytes"),
                         (F.coalesce(F.sum(F.col("n")), F.lit(0)) * CODE_BYTES + F.coalesce(F.sum(size), F.lit(0))).alias("encoded_bytes"))
        row = one.select(F.lit(c).alias("column_name"), "levels", "text_bytes", "encoded_bytes", (F.col("text_bytes") - F.col("encoded_bytes")).alias("saved_bytes"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else df.sparkSession.createDataFrame(
        [], "column_name string, levels long, text_bytes long, encoded_bytes long, saved_bytes long")
