"""Sinks and the run log.

Everything is written by Spark's own writers into folders (one file per
task), never through the driver.  The run log is an append-only Parquet
table partitioned by day; reading one run back is a filtered scan.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabprofile.session import ensure_checkpoint_dir

RUN_SCHEMA = ("run_id string, user_id int, dataset_name string, target_column string, model_choice string, "
              "accuracy double, created_at timestamp, notes string, status string, analysis_results string, "
              "day date")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """The cleaned / processed dataset (CSV with header, or Parquet).  CSV texts keep the
    white space at both ends; those with line breaks are quoted (read with ``multiline``)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.format(fmt).save(path)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder (``spark.checkpoint.dir``) and read back:
    several readers see the same rows, and a lost executor costs a re-read, no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result table as JSON lines (keys are column names, so they
    are strings by construction; values are Spark's own JSON encodings)."""
    df.write.mode(mode).json(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON string column ``json``."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def parse_json_rows(df: DataFrame, schema, column: str = "json") -> DataFrame:
    """The load side of :func:`to_json_rows`; text that is no JSON gives NULLs."""
    return df.select(F.from_json(F.col(f"`{column}`"), schema).alias("r")).select("r.*")


def append_runs(runs: DataFrame, path: str) -> None:
    """R7 for many runs at once: rows with any of the log's columns are appended to it; a
    missing column is NULL, ``status`` is ``completed`` by default, ``day`` follows
    ``created_at``."""
    kinds = dict(part.strip().split(" ", 1) for part in RUN_SCHEMA.split(","))
    cols = [(F.col(f"`{c}`") if c in runs.columns else F.lit("completed" if c == "status" else None)).cast(t).alias(c)
            for c, t in kinds.items() if c != "day"]
    runs.select(*cols).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def log_run(spark: SparkSession, path: str, dataset_name: str, *, user_id: int | None = None,
            target_column: str | None = None, model_choice: str | None = None, accuracy: float | None = None,
            notes: str | None = None, status: str = "completed", analysis_results: dict | None = None,
            run_id: str | None = None) -> str:
    """Append one row to the run log; returns the run id."""
    rid = run_id or uuid.uuid4().hex
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    row = [(rid, user_id, dataset_name, target_column, model_choice, accuracy, now, notes, status,
            json.dumps(analysis_results, default=str) if analysis_results is not None else None, now.date())]
    spark.createDataFrame(row, RUN_SCHEMA).write.mode("append").partitionBy("day").parquet(path)
    return rid


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One run back by id."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def latest_runs(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    """K5 per user: the ``k`` newest runs of every user with their ``rank`` (ties: the
    smaller run id); a task ships at most ``k`` rows a user."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("run_id"))
    return spark.read.parquet(path).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def history(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    """K5: runs newest first, optionally of one user."""
    runs = spark.read.parquet(path)
    if user_id is not None:
        runs = runs.where(F.col("user_id") == user_id)
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id"))
