"""The pipeline against the same decisions made in plain Python, stage by stage."""

import collections
import itertools
import re
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from tabprofile.llm import passages, queries
from test_operators import SCHEMA, brute_components, brute_rules, brute_simhash, packed_ids


def test_stages(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    at, kept = docs, set(text)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = passages.train(docs, labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.stored(stage(spark, at, sf), name)
        assert at.columns == docs.columns and at.schema == docs.schema
        if name == "quality_classifier":
            ids = sorted(kept)
            p, _ = passages.forward(model, *passages.described([text[i] or "" for i in ids]))
            kept = {i for i, x in zip(ids, p) if x >= 0.5}
        elif name == "quality_rules":  # no host of this table is bad
            kept = {i for i in kept if not ((n := brute_rules(text[i]))[0] < 10 or 100 * n[4] > 20 * n[0])}
        elif name == "exact_dedup":
            groups = collections.defaultdict(list)
            for i in kept:
                groups[re.sub("[ \t-\r]", "", text[i] or "")].append((-len(text[i] or ""), i))
            kept = {min(g)[1] for g in groups.values()}
        else:
            ids = sorted(kept)
            kept = {ids[k] for k in brute_components([brute_simhash(text[i]) for i in ids], 4)}
        assert {r.doc_id for r in at.collect()} == kept, name
    tokenizer = queries.byte_bpe.worker_encoder({"json": queries._file(queries.BYTE_BPE), "pattern": queries.public_tokenizers.PATTERN})
    found = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        found[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert set(found) == kept
    for i, pieces in found.items():
        ids = tokenizer.encode([text[i] or ""])[0] + packed_ids([2])
        for _, start, length, crc in pieces:
            assert zlib.crc32(ids[4 * start:4 * (start + length)]) == crc
        assert sum(p[2] for p in pieces) == len(ids) // 4


def test_empty_and_awkward_tables(spark, tmp_path):
    rows = [(None, None), (1, None), (1, None), (2, ""), (None, "word " * 30)]
    for table in ([], rows):
        sf = str(tmp_path / f"t{len(table)}")
        docs = spark.createDataFrame([(i, t, *(None,) * 13) for i, t in table], SCHEMA)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        at = spark.read.parquet(f"{sf}/documents.parquet")
        for (name, stage), _ in itertools.zip_longest(corpus_pipeline.STAGES[:-1], []):
            at = stage(spark, at, sf)
            assert at.columns == docs.columns, name
        result = corpus_pipeline.run(spark, sf)
        assert result.where(F.col("length") < 1).count() == 0
