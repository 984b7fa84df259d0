"""Exact deduplication by content sort (operator 5).

Texts are normalised by deleting white space.  Sampled splitters range-partition the rows
on (first normalised characters, SHA-256, doc_id, row): equal texts are neighbours, and a
text that a third of all rows share is spread over many ranges.  The first characters and
the digest only order the rows; equality is decided by comparing the whole normalised
texts of neighbours.  Spark sorts each range externally, the row to keep first among
equals, and a task streams it once, holding one text.  A run of equal rows that touches an
end of its range may go on in the next one: the first and last runs of all ranges, two a
range at most, are settled among themselves by their digests.

Defined results: null text is empty, and empty or all-white texts equal each other; of
equal texts the longest original (code points) stays, then the smallest doc_id (null ids
last); a repeated row is a row of the group and only one copy stays; an empty table gives
an empty result; other columns are carried or ignored and can't clash, since they travel
in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import SPACE, stored

LEAD = 24  # characters that lead the sort key


def _ranges(docs: DataFrame, carry) -> DataFrame:
    """Rows sorted by content within ranges; of equal texts the one to keep comes first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    norm = F.translate(text, SPACE, "")
    rows = docs.select(F.col("doc_id").alias("key"), F.length(text).alias("points"), norm.alias("norm"),
                       F.sha2(norm, 256).alias("sha"), carry.alias("carry"), F.monotonically_increasing_id().alias("row"))
    lead, key = F.substring("norm", 1, LEAD), F.col("key").asc_nulls_last()
    return rows.repartitionByRange(lead, "sha", key, "row").sortWithinPartitions(
        lead, "sha", "norm", F.desc("points"), key, "row")


def runs(docs: DataFrame, carry=None) -> DataFrame:
    """Each row with the run of equal neighbours it stands in, as a stored table.

    Columns: carry (struct of the columns kept), key, sha, points, run (unique per run and
    range), first (of its run in its range), edge (the run may touch an end of its range),
    order (place of the row, unique).
    """
    carry = F.struct("doc_id") if carry is None else carry
    rows = _ranges(docs, carry)
    fields = {f.name: f for f in rows.schema}
    kinds = {n: fields[n].dataType.simpleString() for n in ("key", "carry")}

    def task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 40
        before, run, place = None, base, base
        held = None  # the newest batch, until it's known whether it holds the last run
        first = base
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, number, starts = batch.column(2), [], []
            for i in range(batch.num_rows):
                text = norm[i].as_buffer()
                same = before is not None and text.equals(before)
                if before is not None and not same:
                    run += 1
                before = text
                number.append(run)
                starts.append(not same)
            before = pa.py_buffer(before.to_pybytes())  # lets go of the batch
            out = [batch.column(4), batch.column(0), batch.column(3), batch.column(1),
                   np.array(number, np.int64), np.arange(place, place + batch.num_rows), np.array(starts)]
            place += batch.num_rows
            if held is not None:
                yield from ended(held, first, run)
            held = out
        if held is not None:
            yield from ended(held, first, run)

    def ended(cols, first, last):
        import pyarrow as pa
        number = cols[4]
        edge = (number == first) | (number == last)
        yield pa.RecordBatch.from_arrays([*cols[:4], pa.array(number), pa.array(cols[6]), pa.array(edge), pa.array(cols[5])],
                                         ["carry", "key", "sha", "points", "run", "first", "edge", "order"])

    schema = f"carry {kinds['carry']}, key {kinds['key']}, sha string, points int, run long, first boolean, edge boolean, order long"
    return stored(rows.select("key", "points", "norm", "sha", "carry").mapInArrow(task, schema), "runs")


def _best():
    return F.struct((-F.col("points")).alias("p"), F.col("key").isNull().alias("n"), F.col("key").alias("k"),
                    F.col("order").alias("o"))


def groups(rows: DataFrame) -> DataFrame:
    """``runs`` rows with keep_id, keep_order and group_size."""
    by_run = rows.groupBy("run").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("n"),
                                     F.max("edge").alias("edge"), F.first("sha").alias("sha"))
    crossing = by_run.where("edge").groupBy("sha").agg(F.min("best").alias("all_best"), F.sum("n").alias("all_n"))
    whole = by_run.join(crossing.withColumnRenamed("sha", "all_sha"), F.col("edge") & (F.col("sha") == F.col("all_sha")), "left")
    settled = whole.select(F.col("run").alias("own_run"), F.coalesce("all_best", "best").alias("best"),
                           F.coalesce("all_n", "n").alias("group_size"))
    return rows.join(settled, rows.run == settled.own_run).select(
        "key", "sha", F.col("best.k").alias("keep_id"), F.col("best.o").alias("keep_order"), "order", "group_size")


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return groups(runs(docs)).select(F.col("key").alias("doc_id"), "keep_id", "group_size",
                                     (F.col("order") == F.col("keep_order")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that equal a kept one, all columns as they were.

    The first row of a run inside its range stays.  Only first rows of runs at the ends of
    ranges, two a range at most, are joined with their rivals of other ranges."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.select("*", F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"))
    rows = runs(plain, F.struct(*[f"c{i}" for i in range(len(names))])).where("first")
    ends = rows.where("edge")
    best = ends.groupBy("sha").agg(F.min(_best()).alias("best")).select(
        F.col("sha").alias("best_sha"), F.col("best.o").alias("best_order"))
    settled = ends.join(best, (F.col("sha") == F.col("best_sha")) & (F.col("order") == F.col("best_order")), "left_semi")
    return rows.where("not edge").select("carry.*").unionByName(settled.select("carry.*")).toDF(*names)
