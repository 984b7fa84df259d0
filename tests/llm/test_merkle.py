"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib

import pytest

from tabprofile.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, at long, kid string, h string, path string, key string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels, from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        out.append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        i //= 8
    return out


def expected(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        changed = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 and r[1] is not None
        groups.setdefault(r[2], []).append((r[0], leaf(r, r[1]), leaf(r, r[1].translate(lower) if changed else r[1])))
    trees = {}
    for g, found in groups.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in found])
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (doc_id, own, seen) in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(top, k)
            folded = seen
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


def rows(langs, n, seed=4):
    r = random.Random(seed)
    out = [(0, None, None, None, None), (1, "", "", "", 0), (1, "A", "", "", 0), (None, "Null id", "en", None, 3), (None, None, "en", "s", 3)]
    out += [(i, r.choice(["ABC def", "plain é", "x" * 50_000, ""]), r.choice(langs), f"s{i % 3}", i * 7) for i in range(n)]
    return out + [out[-1], out[-1], (5, "late", "alone", None, None)]


@pytest.mark.parametrize("langs, n", [(["en"], 600), ([None, "en", "", "é", "=", "-"], 90), ([f"l{i}" for i in range(70)], 160), (["a"], 0)])
def test_query_is_the_plain_tree(spark, tmp_path, langs, n):
    table = rows(langs, n)
    spark.createDataFrame([(*r, *(None,) * 6) for r in table], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_merkle_slot_pivot(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(repr, map(tuple, found.collect())))
    want = expected(table)
    assert got == sorted(map(repr, want))
    assert {r[-1] for r in want} == {True, False} or n == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_tree_sizes(spark, n):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "s", i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    m = merkle.manifest(merkle.leaves(docs, list(FIELDS), "doc_id", "lang"))
    found = merkle.proofs(m).collect()
    want = tree([leaf((i, f"T{i}", "en", "s", i), f"T{i}") for i in range(n)])
    assert m.root == want[-1][0] and len(found) == n
    assert all(r["verified"] and len(r["path"]) == len(want) - 1 for r in found)


def test_empty_table(spark):
    m = merkle.manifest(merkle.leaves(spark.createDataFrame([], SCHEMA), list(FIELDS), "doc_id", "lang"))
    assert m.root is None and merkle.digests(merkle.proofs(m)).collect() == []
