"""K-d sharding against a plain version that sorts rows, and the laws of its result."""

import collections
import datetime
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tabprofile.llm import kdtree, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard long, slot string, row string, node int, at int, codes int"


def rows(seed=2, n=400):
    r = random.Random(seed)
    out = [(1, None, None, None, None), (None, "", "en", "src1", None), (None, "x" * 30_000, "en", "src1", 30_000), (2, "é" * 40, "", "", 40)]
    for i in range(n):
        size = r.choice([0, 5, 40, 40, 400, r.randint(1, 900)])
        out.append((i, "é"[:size] + "a" * size, r.choice(["en", "en", "en", "fr", None]), "src7" if r.random() < .4 else f"src{r.randrange(20)}", size))
    return out + [out[-1]] * (n // 3)  # a third is one row


def table(spark, found):
    return spark.createDataFrame([(*r, *(None,) * 6) for r in found], SCHEMA).repartition(5)


def plain(found, count):
    """``found``: (codes, row number, size); the shard of each row number by sorting."""
    shard, todo = {}, [(found, count, 0)]
    while todo:
        rows, n, first = todo.pop()
        if n == 1:
            shard.update({x[1]: first for x in rows})
            continue
        dims = range(len(rows[0][0])) if rows else [0]
        dim = max(dims, key=lambda d: (max(x[0][d] for x in rows) - min(x[0][d] for x in rows), -d)) if rows else 0
        rows = sorted(rows, key=lambda x: (x[0][dim], x[1]))
        goal, before, cut = sum(x[2] for x in rows) * (n // 2) / n, 0, 0
        for i, x in enumerate(rows):
            if before + x[2] >= goal:
                cut = i + (before + x[2] - goal <= goal - before)
                break
            before += x[2]
        todo += [(rows[:cut], n // 2, first), (rows[cut:], n - n // 2, first + n // 2)]
    return shard


@pytest.mark.parametrize("count, buckets", [(8, 65_536), (8, 128), (5, 256), (1, 64)])
def test_shards_are_the_plain_tree(spark, monkeypatch, count, buckets):
    held = {}
    monkeypatch.setattr(kdtree, "stored", lambda df, name, keep=kdtree.stored: held.setdefault(name, keep(df, name)))
    found = kdtree.shards(table(spark, rows()), ["source", "lang", "n_chars", "doc_id"], count=count, buckets=buckets)
    got = [(tuple(r["row"])[:5], r["size"], r["shard"], r["slot"]) for r in found.collect()]
    stored = held["shards"].select("row", "codes", "at", "size").collect()
    want = plain([(r["codes"], r["at"], r["size"]) for r in stored], count)
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((order(a), s) for a, _, s, _ in got) == sorted((order(tuple(r["row"])[:5]), want[r["at"]]) for r in stored)
    by = collections.defaultdict(list)
    for _, _, shard, slot in got:
        by[shard].append(slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_codes_keep_the_order(spark):
    found = [(None, None, None), (1.0, "src10", datetime.date(2020, 1, 1)), (float("inf"), "src2", datetime.date(2021, 1, 1)),
             (float("-inf"), "src", datetime.date(1960, 1, 1)), (float("nan"), "srcé", None), (1e300, "srcz", None), (-1e300, "src10", None)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(found)], "k string, a double, b string, c date")
    codes = df.select("*", *[c.alias(f"z{i}") for i, c in enumerate(kdtree._codes(df, ["a", "b", "c"]))]).collect()
    nothing = lambda v: v is None or v != v
    for name, code, key in (("a", "z0", float), ("b", "z1", lambda s: s.encode()), ("c", "z2", lambda d: d)):
        assert all(r[code] == 0 for r in codes if nothing(r[name]))
        full = sorted((r for r in codes if not nothing(r[name])), key=lambda r: key(r[name]))
        assert [r[code] for r in full] == sorted(r[code] for r in full) and min(r[code] for r in full) >= 1


def test_bytes_are_near_equal_and_nothing_is_lost(spark, tmp_path):
    found = rows(5, 3000)
    table(spark, found).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_kd_shards(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = out.collect()
    size = lambda t: len((t or "").encode()) + 1
    want = collections.Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in found)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    total = collections.Counter()
    for r in got:
        total[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    share = sum(total.values()) / 8
    assert sorted(total) == list(range(8)) and max(abs(b - share) for b in total.values()) <= 2 * max(size(r[1]) for r in found)


def test_target_bytes_and_files(spark, tmp_path):
    found = kdtree.shards(table(spark, rows()), ["n_chars"], target_bytes=20_000)
    back = spark.read.parquet(kdtree.save(found, f"{tmp_path}/sharded"))
    sums = {r["shard"]: r["b"] for r in back.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    total = sum(sums.values())
    assert len(sums) == -(-total // 20_000) and back.count() == len(rows())
    with pytest.raises(ValueError):
        kdtree.shards(table(spark, rows(1, 3)), ["n_chars"], count=kdtree.MOST + 1)


def test_few_and_no_rows(spark):
    assert kdtree.shards(table(spark, []), ["source", "n_chars"], count=8).collect() == []
    got = kdtree.shards(table(spark, [(1, "abc", "en", "s", 3)]), ["source", "n_chars"], count=8).collect()
    assert len(got) == 1 and got[0]["slot"] == 0
    one = table(spark, [(1, "same", "en", "s", 4)] * 16)
    assert collections.Counter(r["shard"] for r in kdtree.shards(one, ["source"], count=8).collect()) == {i: 2 for i in range(8)}
