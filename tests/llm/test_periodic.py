"""Periodic runs against a plain search over all periods, and the query's numbers by hand."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tabprofile.llm import periodic


def plain_runs(t):
    n, seen = len(t), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and t[j] == t[j + q]:
                j += 1
            if j - i >= q:
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((b, e - b, q) for (b, e), q in seen.items() if e - b >= 12), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def powers(r):
    u = [r.randrange(2) for _ in range(r.randint(1, 6))]
    return u * r.randint(3, 40) + u[:r.randint(0, len(u))] + u * r.randint(3, 40)  # touching runs of one period


def nested(r):
    u = [r.randrange(2) for _ in range(r.randint(1, 5))]
    v = u * r.randint(2, 12) + u[:r.randint(0, len(u))]
    return [9] * r.randint(0, 5) + v * r.randint(2, 5) + v[:r.randint(0, len(v))]


def repeats(r):
    t = []
    while len(t) < r.randint(20, 500):
        u = [r.randrange(3) for _ in range(r.randint(1, 50))]
        t += u * r.randint(1, 4)
        if r.random() < .3:
            t += t[-r.randint(1, len(t)):]
    return t[:600]


def sparse(r):
    return ([0] * r.randint(5, 60) + [1] + [0] * r.randint(5, 60) + [1] + [0] * r.randint(5, 90)) * r.randint(1, 3)


@pytest.mark.parametrize("seed", range(3))
def test_all_runs_are_found(seed):
    r = random.Random(seed)
    makers = [lambda r: [r.randrange(2) for _ in range(r.randint(0, 300))], lambda r: [r.randrange(4) for _ in range(r.randint(0, 300))],
              lambda r: fibonacci(r.randint(10, 400)), powers, nested, repeats, sparse]
    tests = [makers[k % len(makers)](r) for k in range(210)]
    got = [x for i in range(0, 210, 30) for x in periodic.find_runs([np.array(t, np.int32) for t in tests[i:i + 30]])]
    assert got == [plain_runs(t) for t in tests]
    assert sum(q > periodic.DIRECT for x in got for _, _, q in x) > 100


def text_of(t):
    return " ".join("abcdefghijk"[x] for x in t)


def rows():
    r = random.Random(9)
    out = [(0, None), (1, ""), (2, " \n\t\x0b "), (3, "one two"), (None, text_of(powers(r))), (None, None), (4, "x y " * 40),
           (5, text_of(repeats(r))), (5, text_of(repeats(r))), (6, "\n".join(["same line here"] * 30)), (7, "w " * 20_000)]
    out += [(i, text_of(repeats(r))) for i in range(20, 80)]
    return out + [out[-1], out[-1]]


SCHEMA = "doc_id long, text string, words string, runs long, h long, n long, a long"


def expected(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = plain_runs([codes[w] for w in words]) if n < 5000 else [(0, n, 1)]
    dropped = {i for b, length, q in runs for i in range(b + q, b + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{b},{length},{q}\n" for b, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_numbers(spark, tmp_path):
    from tabprofile.llm import queries
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows()], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r)
    got = sorted((tuple(str(x) for x in r) for r in found.collect()), key=key)
    want = sorted((tuple(str(x) for x in expected(*r)) for r in rows()), key=key)
    assert got == want
    # planted repetitions are among the rows
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(20, 80))


def test_empty_table(spark):
    assert periodic.digests(periodic.periodic_runs(periodic.planted(spark.createDataFrame([], SCHEMA)))).collect() == []
