"""Exact global positions and running totals without a single-task window.

``df`` is range-partitioned and sorted by (group, order, a row number), so that equal rows
or one large group spread over many ranges; the sorted rows are stored once with
consecutive numbers inside each range.  Counts (or sums) per range and group are a small
table whose running totals are the offsets of the ranges.  The number a row gets is its
place inside its range plus the offset, so no task ever sees more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.roles import qcol
from tabprofile.sources.sinks import shared_table

#: most rows of the offset table (ranges + groups, about 100 bytes a row) that are broadcast
OFFSETS_BROADCAST = 100_000


def _in_order(df: DataFrame, order: list[Column], group: list[str], more: list[Column]) -> DataFrame:
    """Stored rows: r (all columns), g (the group), at (range number << 33 | place), and ``more``."""
    g = F.struct(*[qcol(c) for c in group]) if group else F.lit(0)
    keyed = df.select(F.struct(*[qcol(c) for c in df.columns]).alias("r"), g.alias("g"),
                      *[o.alias(f"m{i}") for i, o in enumerate(more)],
                      F.struct(*order).alias("o"), F.monotonically_increasing_id().alias("u"))
    in_ranges = keyed.repartitionByRange("g", "o", "u").sortWithinPartitions("g", "o", "u")
    return shared_table(in_ranges.select("r", "g", *[f"m{i}" for i in range(len(more))],
                                         F.monotonically_increasing_id().alias("at")), "ranks")


def _joined(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """``rows`` with the offsets of their range and group; broadcast after a check of the size."""
    offsets = shared_table(offsets, "offsets")
    side = F.broadcast(offsets) if offsets.count() <= OFFSETS_BROADCAST else offsets
    return rows.join(side, (F.shiftright("at", 33) == F.col("range")) & (F.col("g") == F.col("own_g")))


def positions(df: DataFrame, order: list[Column], group: list[str] = (), name: str = "position") -> DataFrame:
    """``df`` with the 0-based place of each row inside its group in the given order.

    ``order`` holds value expressions, ascending with nulls first; rows equal in all of them
    follow each other in no fixed order, and null group values are a group.  An empty
    table stays empty."""
    if name in df.columns:
        raise ValueError(f"the table already has a column {name}")
    rows = _in_order(df, order, list(group), [])
    starts = rows.groupBy(F.shiftright("at", 33).alias("range"), F.col("g").alias("own_g")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("own_g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = starts.select("range", "own_g", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return _joined(rows, offsets).select("r.*", (F.col("at") + F.col("shift")).alias(name))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], group: list[str] = ()) -> DataFrame:
    """``df`` with, for each entry of ``sums``, the total of that expression over the rows of
    the group that come before the row.  Order and groups as in :func:`positions`."""
    clash = set(sums) & set(df.columns)
    if clash:
        raise ValueError(f"the table already has columns {sorted(clash)}")
    rows = _in_order(df, order, list(group), list(sums.values())).withColumn("range", F.shiftright("at", 33))
    totals = rows.groupBy("range", F.col("g").alias("own_g")).agg(*[F.sum(f"m{i}").alias(f"t{i}") for i in range(len(sums))])
    before = Window.partitionBy("own_g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", "own_g", *[F.sum(f"t{i}").over(before).alias(f"t{i}") for i in range(len(sums))])
    inside = Window.partitionBy("range", "g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("r", "g", "at", *[F.sum(f"m{i}").over(inside).alias(f"m{i}") for i in range(len(sums))])
    zero = F.lit(0)
    return _joined(local, offsets).select("r.*", *[
        (F.coalesce(f"m{i}", zero) + F.coalesce(f"t{i}", zero)).alias(n) for i, n in enumerate(sums)])
