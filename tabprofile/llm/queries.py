"""The registered queries of this subpackage: thin, over the whole of their tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprofile.llm import byte_bpe, exact, host_rules, katz, kdtree, merkle, packing, passages, periodic, records, simhash, toxicity, warc
from tabprofile.llm.common import remainder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_warc_derivatives(spark, sf_dir):
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))


def op2_katz_backoff(spark, sf_dir):
    return katz.scores(_table(spark, sf_dir, "documents"))


def op3_simhash_anchors(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op4_binary_records(spark, sf_dir):
    manifest = records.write(_table(spark, sf_dir, "documents"), _file(WORD_BPE), public_tokenizers.PATTERN, end_id=1, cached=1_000_000)
    return records.digest(records.read(manifest))


def op5_content_sort(spark, sf_dir):
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.packed(_table(spark, sf_dir, "documents"), _file(BYTE_BPE), public_tokenizers.PATTERN, end_id=2, capacity=1024, cached=1_000_000)


def op7_attention_mil(spark, sf_dir):
    return passages.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op8_host_rules(spark, sf_dir):
    return host_rules.judged(_table(spark, sf_dir, "documents"))


def op9_kneser_ney_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op10_byte_bpe(spark, sf_dir):
    pattern = public_tokenizers.PATTERN
    tokenizer = byte_bpe.tokenizer_json(byte_bpe.read_ranks(BYTE_RANKS), pattern)
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer, pattern)


def op11_kd_shards(spark, sf_dir):
    found = kdtree.shards(_table(spark, sf_dir, "documents"), ["source", "lang", "n_chars", "doc_id"], count=8)
    return kdtree.digests(found)


def op12_merkle_slot_pivot(spark, sf_dir):
    changed = {"text": F.when(remainder("doc_id", 3) == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))}
    rows = merkle.leaves(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", changed)
    return merkle.digests(merkle.proofs(merkle.manifest(rows)))


def op13_periodic_runs(spark, sf_dir):
    return periodic.digests(periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


# stages of the pipeline: (spark, docs, sf_dir) -> DataFrame

def quality_stage(spark, docs, sf_dir):
    return passages.keep(docs, _table(spark, sf_dir, "labels"), threshold=0.7)


def rules_stage(spark, docs, sf_dir):
    return host_rules.keep(docs)


def exact_stage(spark, docs, sf_dir):
    return exact.deduplicate(docs)


def near_stage(spark, docs, sf_dir):
    return simhash.deduplicate(docs, shingle=4, distance=4)


def packing_stage(spark, docs, sf_dir):
    return packing.packed(docs, _file(BYTE_BPE), public_tokenizers.PATTERN, end_id=2, capacity=1024)


QUERIES = {f.__name__: f for f in (
    op1_warc_derivatives, op2_katz_backoff, op3_simhash_anchors, op4_binary_records, op5_content_sort, op6_best_fit_packing,
    op7_attention_mil, op8_host_rules, op9_kneser_ney_toxicity, op10_byte_bpe, op11_kd_shards, op12_merkle_slot_pivot,
    op13_periodic_runs)}

ORACLE = {
    "op1_warc_derivatives": warc.oracle_sql(),
    "op5_content_sort": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
g as (select *, row_number() over w as r, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size from t
    window w as (partition by norm order by length(text) desc, doc_id nulls last))
select doc_id, keep_id, group_size, r = 1 as kept, sha256(norm) as text_sha256 from g""",
    "op8_host_rules": host_rules.oracle_sql(),
    "op12_merkle_slot_pivot": merkle.oracle_sql(),
}
