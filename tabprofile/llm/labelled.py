"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import remainder, texts

TASKS = 16  # the sample is small in bytes, not in work


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], parts: int, held: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of up to ``rows[label]`` labelled ids of each class.

    Only ids whose crc32 remainder by ``parts`` isn't ``held`` are taken, in the order of a
    hash of the id.  A repeated label row counts once (the larger label); null labels and
    ids are no labels.  The sampled ids are bounded by ``rows``, hence the broadcast.  Of rows
    that share an id the one whose text has the least hash is taken, so ``rows`` bounds what is
    returned, too, and no id outweighs others.  A text is taken whole, however long.
    """
    known = labels.select(F.col("doc_id").alias("key"), F.col(label).cast("int").alias("label")) \
        .where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & (remainder("key", parts) != held)) \
        .groupBy("key").agg(F.max("label").alias("label"))
    taken = [known.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(n) for k, n in sorted(rows.items())]
    ids = taken[0]
    for more in taken[1:]:
        ids = ids.unionByName(more)
    rows_of = texts(docs)
    found = rows_of.join(F.broadcast(ids), rows_of.doc_id == ids.key)
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select("doc_id", "least.text", "label").repartition(TASKS)
