"""Frequent terms against plain counting, with summaries that overflow; dictionary encoding there and back."""

import collections
import random

import pytest

from tabprofile.operators import encode, terms


def texts(seed=1, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    out = [" ".join(r.choices(vocabulary, weights, k=r.randint(0, 80))) for _ in range(n)]
    return out + [None, "", " \t\n ", "W0 w0\tW1 x É é", "w0 " * 500]


def plain(rows):
    count, docs = collections.Counter(), collections.Counter()
    for t in rows:
        words = (t or "").encode().lower().split()
        count.update(words)
        docs.update(set(words))
    return {w.decode(): (c, docs[w]) for w, c in count.items()}


@pytest.mark.parametrize("capacity", [4, 50, 4096])
def test_frequent_terms_are_exact(spark, capacity):
    rows = texts()
    df = spark.createDataFrame([(t, 1) for t in rows], "`a.b` string, c int").repartition(4)
    got = [(r["rank"], r["term"], r["count"], r["documents"]) for r in terms.frequent_terms(df, "a.b", 15, capacity).collect()]
    best = sorted(plain(rows).items(), key=lambda x: (-x[1][0], x[0]))[:15]
    assert sorted(got) == [(i + 1, w, c, d) for i, (w, (c, d)) in enumerate(best)]


def test_summaries_bound_every_count():
    rows = [t or "" for t in texts(2)]
    true = {w.encode(): c for w, (c, _) in plain(rows).items()}
    total = sum(true.values())
    for capacity in (3, 20, 200):
        held, error = terms.summary([rows[:100], rows[100:]], capacity)
        assert len(held) <= capacity and error <= total / (capacity + 1)
        assert all(held[w] <= c <= held[w] + error for w, c in true.items())


def test_few_terms_and_profile(spark):
    df = spark.createDataFrame([("a b",), ("b",), (None,), ("",)], "t string")
    assert [(r["rank"], r["term"], r["count"]) for r in terms.frequent_terms(df, "t", 5).orderBy("rank").collect()] == [(1, "b", 2), (2, "a", 1)]
    assert terms.frequent_terms(df.limit(0), "t").collect() == []
    r = terms.text_profile(df).first()
    assert tuple(r) == ("t", 3, 1, 0, pytest.approx(4 / 3), 3, pytest.approx(1.0))
    assert terms.text_profile(spark.range(2)).collect() == []


def test_encoding_round_trip(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["x", "x", "x", "long value", "", None]), f"id{i}", None, r.choice(["é", "z"])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, `my.kind` string, key string, none string, code string").repartition(5)
    assert encode.category_columns(df) == ["my.kind", "code"] == encode.category_columns(df, 0.4)
    e = encode.encode_categories(df)
    assert e.table.columns == df.columns and dict(e.table.dtypes)["my.kind"] == "int"
    assert {(x["code"], x["value"]) for x in e.levels["my.kind"].collect()} == {(0, ""), (1, "long value"), (2, "x")}
    key = lambda x: x[0]
    assert sorted((tuple(x) for x in e.decode().collect()), key=key) == rows
    assert all((x["my.kind"] is None) == (y[1] is None) for x, y in zip(sorted(e.table.collect(), key=key), rows))
    saved = {x["column_name"]: x for x in encode.saved_bytes(df).collect()}
    kept = [x[1] for x in rows if x[1] is not None]
    assert saved["my.kind"]["text_bytes"] == sum(map(len, kept)) and saved["my.kind"]["encoded_bytes"] == 4 * len(kept) + 11 and saved["my.kind"]["levels"] == 3
    assert encode.saved_bytes(spark.range(3)).collect() == [] and encode.encode_categories(spark.range(3).toDF("n")).decode().count() == 3
