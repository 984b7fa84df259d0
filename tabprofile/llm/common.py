"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprofile.session import ensure_checkpoint_dir

# the white space of all contracts: [\x20\x09-\x0D]; bytes.split() splits on exactly these
SPACE = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: what follows re-reads a committed table if an executor is lost, and
    several readers see the same rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns can't clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def remainder(key: str, parts: int):
    """crc32 of the id as text, modulo ``parts`` (null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def slices(batch, rows: int = 256):
    """An Arrow batch in pieces of few rows, so that few texts are Python objects at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def text_offsets(column):
    """Where each text of an Arrow string array begins and the last ends in its data buffer."""
    import numpy as np
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def portions(batch, column: int, size: int = 1 << 22):
    """An Arrow batch in pieces of about ``size`` bytes of text; a longer text is a piece of its own."""
    import numpy as np
    ends, start = text_offsets(batch.column(column)), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
