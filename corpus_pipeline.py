"""Corpus pipeline: quality classifier, quality rules, exact and near deduplication, packing.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the
next stage's documents, the last one the packed pieces.  Rows that a stage rejects go, and
every stage works on all that the one before it kept.  ``run`` writes each stage's result to
the shared folder and reads it back, so a later stage starts from a committed table.

Defined results: the stages' own, for nulls, empty and long texts, ties, repeated rows,
empty tables and further columns (see their modules); rows without a doc_id pass the first
three stages by their own text and are packed.
"""

from pyspark.sql import DataFrame, SparkSession

from tabprofile.llm.common import stored
from tabprofile.llm.queries import exact_stage, near_stage, packing_stage, quality_stage, rules_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("quality_rules", rules_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the classifier, SimHash and the tokenizer are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
