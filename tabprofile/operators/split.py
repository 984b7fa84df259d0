"""Stratified train/test split, folds and class weights.

Rows are ordered inside each class by a seeded md5 key.  The rank of a row within its class
is computed without a window partitioned by class -- such a window would put a class
holding a third of the table into one task.  A row's bucket is the first digits of its key,
so it depends on the row's values alone; rows are counted by (class, bucket), running
counts over that small table give every bucket its offset, and a window inside (class,
bucket) gives the rest.  Equal rows get keys of their own by a copy number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.operators.clean import key_bucket, sample_key, with_copies
from tabprofile.operators.quality import orderable
from tabprofile.roles import qcol

TEST_FRACTION = 0.2
FOLDS = 5
SEED = 42


def rank_within(df: DataFrame, group: list[str], key: str, ties: list | None = None) -> DataFrame:
    """Adds ``rn`` (0-based rank within ``group`` by the md5 column ``key``, then ``ties``)
    and ``group_size``.  Both depend on values alone, so it doesn't matter how often or
    where Spark evaluates ``df``."""
    d = df.withColumn("__h", key_bucket(key))
    names = [qcol(g) for g in group]
    w = Window.partitionBy(*names).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*names, "__h").agg(F.count(F.lit(1)).alias("__c"))  # 65,536 rows a class at most
    counts = counts.withColumn("__off", F.coalesce(F.sum("__c").over(w), F.lit(0))) \
        .withColumn("group_size", F.sum("__c").over(Window.partitionBy(*names))).drop("__c")
    inside = Window.partitionBy(*names, "__h").orderBy(F.col(key), *(ties or []))
    ranked = d.withColumn("__in", F.row_number().over(inside) - 1)
    return (ranked.join(counts, [*group, "__h"]).withColumn("rn", F.col("__off") + F.col("__in")).drop("__h", "__off", "__in"))


def _renamed(df: DataFrame, key_cols: list[str] | None, name: str) -> tuple[DataFrame, list[str] | None]:
    """``df`` with its columns named c0, c1, ..., so that no name of the user's clashes with the
    ones used here, and the key columns' new names."""
    if name in df.columns:
        raise ValueError(f"the table already has a column {name}; choose another name for the result")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain, key_cols and [f"c{df.columns.index(c)}" for c in key_cols]


def _ranked(df: DataFrame, label: str, seed: int, key_cols: list[str] | None, name: str) -> DataFrame:
    plain, keys = _renamed(df, key_cols, name)
    y = f"c{df.columns.index(label)}"
    d = with_copies(plain.where(qcol(y).isNotNull()), keys)
    r = rank_within(d.withColumn("__k", sample_key(d, seed, keys)), [y], "__k", [orderable(plain.schema[c]) for c in keys or plain.columns])
    return r.select(*plain.columns, "rn", "group_size")


def _named(r: DataFrame, df: DataFrame, result, name: str) -> DataFrame:
    return r.select(*[F.col(f"c{i}") for i in range(len(df.columns))], result).toDF(*df.columns, name)


def stratified_split(df: DataFrame, label: str, test_fraction: float = TEST_FRACTION, seed: int = SEED,
                     key_cols: list[str] | None = None, name: str = "split") -> DataFrame:
    """Adds ``split`` (or ``name``) = ``test`` for the first ``ceil(test_fraction * n_c)``
    rows of every class ``c`` in seeded-hash order, else ``train`` (D10: exact
    per-class quotas).  Rows with a missing label are dropped; a table that has the column
    already raises."""
    r = _ranked(df, label, seed, key_cols, name)
    quota = F.ceil(F.col("group_size") * F.lit(test_fraction))
    return _named(r, df, F.when(F.col("rn") < quota, "test").otherwise("train"), name)


def random_split(df: DataFrame, test_fraction: float = TEST_FRACTION, seed: int = SEED,
                 key_cols: list[str] | None = None, name: str = "split") -> DataFrame:
    """M5 (regression): ``split`` (or ``name``) by a seeded row hash, ``pmod(xxhash64(row, copy,
    seed), 10000)`` below ``test_fraction * 10000`` -> test.  Copies of a row fall on either side;
    with ``key_cols`` that identify a row there is no shuffle at all."""
    plain, keys = _renamed(df, key_cols, name)
    d = with_copies(plain, keys)
    h = F.pmod(F.xxhash64(*[orderable(plain.schema[c]) for c in keys or plain.columns], F.col("__copy"), F.lit(seed)), F.lit(10000))
    return _named(d, df, F.when(h < int(test_fraction * 10000), "test").otherwise("train"), name)


def stratified_folds(df: DataFrame, label: str, k: int = FOLDS, seed: int = SEED,
                     key_cols: list[str] | None = None, name: str = "fold") -> DataFrame:
    """Adds ``fold`` (or ``name``) = rank within class (seeded-hash order) mod ``k``,
    so every fold holds ``floor`` or ``ceil`` of ``n_c / k`` rows of each class."""
    r = _ranked(df, label, seed, key_cols, name)
    return _named(r, df, (F.col("rn") % k).cast("int"), name)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M6: balanced weights ``n / (g * n_c)``: ``(class, count, weight)``."""
    c = (df.where(qcol(label).isNotNull()).groupBy(qcol(label).cast("string").alias("class"))
         .agg(F.count(F.lit(1)).alias("count")))
    tot = Window.partitionBy(F.lit(1))  # over the g class rows only
    return c.select("class", "count",
                    (F.sum("count").over(tot) / (F.count(F.lit(1)).over(tot) * F.col("count"))).alias("weight"))
