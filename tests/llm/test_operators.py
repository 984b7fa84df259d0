"""Every operator against a plain Python version, on awkward rows: nulls in any column, empty
and long texts, ties, repeated rows, further columns with clashing names, empty tables."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tabprofile.llm import byte_bpe, chunked, exact, host_rules, katz, packing, passages, queries, records, simhash, toxicity, warc
from tabprofile.llm.labelled import sample

WHITE = "[ \t-\r]"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, row long, run long, key string, "
          "carry string, component_id long, bucket long, label int, host string, sequence_id long")


def words_of(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


r0 = random.Random(5)
VOCABULARY = ["".join(r0.choice("abcdeéüß") for _ in range(r0.randint(1, 7))) for _ in range(300)] + ["The", "and,", "x.", "|", "***"]
BASE = words_of(r0, 120) + ".\nlast line"


def rows():
    r = random.Random(6)
    out = [(0, None), (1, ""), (2, " \n\t\x0b\x0c\r "), (3, BASE), (4, BASE.replace(" ", "  ")), (5, BASE), (5, BASE), (None, BASE),
           (None, "no id " + words_of(r, 40)), (6, words_of(r, 30_000)), (7, "é \xa0 x　y\x1c ​z \U0001F600<|endoftext|> 'S don't"),
           (8, "one two"), (9, "one two"), (10, "A B C D"), (11, "\n".join(["same line here"] * 30)), (-3, BASE + " extra")]
    out += [(i, words_of(r, r.randint(1, 400))) for i in range(20, 60)]
    near = out[-1][1]
    return out + [(70, near + " tail"), (71, near.replace("a", "A"))]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (None,) * 10
    table = [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", None, *extra) for k, (i, t) in enumerate(rows())]
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, by="doc_id"):
    found = collections.defaultdict(list)
    for row in df.collect():
        found[row[by]].append(row)
    return found


# 1 WARC

def test_warc_derivatives_keep_links_headers_and_digests(spark, tmp_path):
    html = "<html lang='de'><title>A &amp; B</title><script>var t='</p>'</script><p>x &#65;&lt;<a href=\"u?a&amp;b\">link</a><!-- c -->" \
           "<p>y<br>z"
    pages = spark.createDataFrame([(1, "http://a/", html, 1), (1, "http://a/", html, 1), (2, None, None, None), (None, "u", "", 2)],
                                  "page_id long, url string, html string, record_id int")
    answers = warc.responses(pages)
    found = warc.derivatives(answers)
    by = collected(found, "refers_to")
    sources = {a.record_id: a for a in answers.collect()}
    assert set(by) == set(sources) and sum(map(len, by.values())) == 8
    for source, made in by.items():
        for m in made:
            assert m.block_digest == "sha256:" + hashlib.sha256(m.block.encode()).hexdigest()
            assert m.content_length == len(m.block.encode()) and m.source_headers == sources[source].http_headers
            assert m.source_digest == "sha256:" + hashlib.sha256(sources[source].payload.encode()).hexdigest()
    page = [m for made in by.values() for m in made if m.target_uri == "http://a/"]
    assert {m.block for m in page if m.warc_type == "conversion"} == {"x A<link\ny\nz"}
    meta = next(m.block for m in page if m.warc_type == "metadata")
    assert meta.startswith("title: A & B\r\nlanguage: de\r\nsource-status: 200\r\n") and meta.endswith("outlinks: 1\r\noutlink: u?a&b\r\n")
    manifest = warc.write(found, str(tmp_path / "w")).collect()
    raw = b"".join(gzip.open(m.path).read() for m in manifest)
    assert sum(m.records for m in manifest) == 8 and raw.count(b"WARC/1.1\r\n") == 8 and raw.count(b"WARC-Refers-To: <urn:uuid:") == 8
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    assert warc.write(found.limit(0), str(tmp_path / "none")).count() == 0


def test_warc_text_of_odd_markup(spark):
    cases = [("a<!-- <script> -->b<SCRIPT x>if(1)<!-- c</script >c", "a b c"), ("<style>p<script></style>x", "x"), ("a<title>t", "a\nt"),
             ("<svg><title>t</title>u</svg>v", "v"), ("&amp;lt; &#38;amp; &#x41;&#0; &#xD800; &lt &copy;", "&lt; &amp; A&#0; &#xD800; &lt &copy;"),
             (" \t a \r\n b<br> <br>\n c < d <b>e</b> &nbsp;", "a b\nc < d e \xa0"), ("&", "&"), ("<p>", ""), ("&amp;" * 3, "&&&")]
    found = spark.createDataFrame(cases, "html string, want string").select(warc.plain_text(F.col("html")).alias("text"), "want").collect()
    assert [r.text for r in found] == [r.want for r in found]


# 2 Katz

def brute_katz(table):
    single, pair, tokens = collections.Counter(), collections.Counter(), []
    for i, t in table:
        w = [x.lower() for x in (t or "").encode().split()] + [katz.END]
        tokens.append((i, w, zlib.crc32((b"" if i is None else str(i).encode())) % 7 == 2))
        if not tokens[-1][2]:
            single.update(w)
            pair.update(zip([katz.START] + w, w))
    n, v = sum(single.values()), len(single)

    def discounts(counts):
        c = collections.Counter(counts)
        return katz.discounts([0, *[c[k] for k in range(1, katz.K + 2)]])

    d1, d2 = discounts(single.values()), discounts(pair.values())

    def kept(c, d):
        return (d[c] if c <= katz.K else 1) * c

    unknown = 1 - sum(kept(c, d1) for c in single.values()) / n if n else 1.0

    def uni(w):
        return kept(single[w], d1) / n if single[w] else unknown

    total, left, mass = collections.Counter(), collections.Counter(), collections.Counter()
    for (u, w), c in pair.items():
        total[u] += c
        left[u] += c - kept(c, d2)
        mass[u] += uni(w)

    def p(u, w):
        if not total[u]:
            return uni(w)
        below, rest = (total[u], left[u]) if left[u] > 1e-12 else (total[u] + 1, 1)
        return kept(pair[u, w], d2) / below if pair[u, w] else rest / below / (1 - mass[u]) * uni(w)

    out = [(i, held, len(w), sum(x in single for x in w), n, sum(math.log10((single[x] + 1) / (n + v + 1)) for x in w),
            sum(math.log10(p(a, b)) for a, b in zip([katz.START] + w, w))) for i, w, held in tokens]
    return out, p, single, total


@pytest.mark.parametrize("small", [False, True])
def test_katz_scores(docs, small, monkeypatch):
    if small:  # many chunks and buckets, contexts in parts
        for name, value in (("CHUNK", 20_000), ("WORD_ENTRIES", 150), ("PAIR_ENTRIES", 3000), ("HOT", 60)):
            monkeypatch.setattr(katz, name, value)
    want, p, single, contexts = brute_katz(rows())
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    got = sorted(map(tuple, katz.scores(docs).collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    for u in itertools.islice(contexts, 60):
        assert sum(p(u, w) for w in single) + p(u, b"not a word") == pytest.approx(1, abs=1e-9)


def test_katz_without_training_text_and_empty(spark, empty):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row.held_out and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.score == 0
    assert katz.scores(empty).count() == 0


def test_katz_discounts_fall_back():
    assert katz.discounts([0, 100, 40, 20, 12, 8, 6])[0] == 0
    for n in ([0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 1, 1, 1, 1, 1, 50]):
        assert all(0 < d < 1 for d in katz.discounts(n)[1:])


def simple_good_turing(n, k):
    """Katz's discounts from counts of counts on Gale and Sampson's line."""
    from statistics import linear_regression
    there = [r for r in range(1, k + 2) if n[r]]
    z = []
    for r in there:
        before = max([q for q in there if q < r], default=0)
        after = min([t for t in there if t > r], default=2 * r - before)
        z.append(n[r] / (0.5 * (after - before)))
    line = linear_regression([math.log(r) for r in there], [math.log(x) for x in z])
    s = {r: math.exp(line.intercept + line.slope * math.log(r)) for r in range(1, k + 2)}
    a = (k + 1) * s[k + 1] / s[1]
    return [((r + 1) * s[r + 1] / s[r] / r - a) / (1 - a) for r in range(1, k + 1)]


def test_katz_discounts_stay_good_turing():
    # counts of counts of sf0.1: only d(4) by the plain counts leaves (0, 1)
    for n, plain in (([0, 207344, 59772, 25017, 14274, 13493, 7080], [0.467, 0.532, 0.699]),
                     ([0, 1579638, 246704, 51653, 21705, 18939, 7580], [0.292, 0.294, 0.547])):
        d = katz.discounts(n)
        assert d[1:4] == pytest.approx(plain, abs=6e-4) and d[4:] == pytest.approx(simple_good_turing(n, 5)[3:])
        assert all(0 < x < 1 for x in d[1:]) and all((r + 1) * d[r + 1] > r * d[r] for r in range(1, 5))
    gaps = [0, 100, 30, 0, 9, 0, 2]  # r* undefined at once
    assert katz.discounts(gaps)[1:] == pytest.approx(simple_good_turing(gaps, 5))
    fine = [0, 1000, 400, 220, 140, 98, 72]
    a = 6 * fine[6] / fine[1]
    assert katz.discounts(fine)[1:] == pytest.approx([((r + 1) * fine[r + 1] / fine[r] / r - a) / (1 - a) for r in range(1, 6)])


# 3 SimHash

def brute_simhash(text, k=4):
    from xxhash import xxh64_intdigest
    w = [x for x in re.split(WHITE + "+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    hashes = [xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= distance:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_simhash_deduplicate_keeps_one_row_a_component(spark):
    r = random.Random(12)
    a, b, c = (words_of(r, 200) for _ in range(3))
    # nulls alone; nulls beside an id; one id on rows of several components; other columns
    table = [(None, a, "1"), (None, a, "2"), (None, b, "3"), (7, b, "4"), (7, c, "5"), (7, c, "6"), (7, b, "7"), (9, c, "8"), (None, "", "9")]
    prints = [brute_simhash(t) for _, t, _ in table]
    roots = brute_components(prints, 4)
    got = simhash.deduplicate(spark.createDataFrame(table, "doc_id long, text string, row string").repartition(4))
    assert got.columns == ["doc_id", "text", "row"]
    found = {(i, t) for i, t, _ in map(tuple, got.collect())}
    assert got.count() == len(set(roots)) == 4 and found == {(None, a), (7, b), (7, c), (None, "")}


def test_simhash_groups(docs, empty):
    table = rows()
    prints = [brute_simhash(t) for _, t in table]
    roots = brute_components(prints, 4)
    least = {}
    for (i, _), k in zip(table, roots):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    want = sorted((i is None, i or 0, f"{p:016x}", least.get(k, -99)) for (i, _), p, k in zip(table, prints, roots))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -99 if r.component_id is None else r.component_id)
                 for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == set(least.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("block", [4096, 15])
def test_anchors_lose_no_link(spark, block):
    r = random.Random(9)
    values = set()
    for _ in range(40):
        v = r.getrandbits(64)
        values.add(v)
        for _ in range(r.choice([0, 3, 12])):
            v ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
            values.add(v)
    values = sorted(values)
    table = spark.createDataFrame([(v - (v >> 63 << 64), i) for i, v in enumerate(values)], "print long, id long")
    found = {n: m for n, m in simhash.components(simhash.links(table, 4, block)).collect()}
    assert [found.get(i, i) for i in range(len(values))] == brute_components(values, 4)


def test_covering_code_covers():
    for bits in (12, 13, 15, 21, 22):
        word = np.arange(4096, dtype=np.uint64) * np.uint64(977) & np.uint64((1 << bits) - 1)
        index, anchor = simhash.anchors(word, 0, bits)
        assert np.bitwise_count(word[index] ^ anchor).max() <= 2
        nearest = np.full(4096, 9)
        np.minimum.at(nearest, index, np.bitwise_count(word[index] ^ anchor))
        assert nearest.max() <= 1  # the covering radius


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 199), (199, 200)]
    found = dict(simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 150)}, 200: 199}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 binary records, 6 packing, 10 byte-level BPE

def ids_of(path):
    tokenizer = chunked.load(queries._file(path))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows()]


def packed_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_records_round_trip(docs, empty, tmp_path):
    folder = str(tmp_path / "records")
    manifest = records.write(docs, queries._file(queries.WORD_BPE), P.PATTERN, 1, folder)
    want = sorted(((i is not None, i or 0), packed_ids(ids + [1])) for (i, _), ids in zip(rows(), ids_of(queries.WORD_BPE)))
    back = sorted(records.read(manifest).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), bytes(r.ids)) for r in back) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in back] == [k for k, _ in want]  # ascending, null first
    assert [r.start for r in back] == [sum(len(r.ids) // 4 for r in back[:k]) for k in range(len(back))]
    shuffled = records.read_shuffled(manifest, 3).collect()
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in shuffled) == sorted((r.doc_id or 0, bytes(r.ids)) for r in back)
    index = records.read_index(manifest).collect()
    assert len(index) == len(back)
    digest = {(r.doc_id, r.ids_crc32) for r in records.digest(records.read(manifest)).collect()}
    assert digest == {(r.doc_id, zlib.crc32(r.ids)) for r in back}
    assert records.read(records.write(empty, queries._file(queries.WORD_BPE), P.PATTERN, 1)).count() == 0
    with open(index[0].path + ".rec", "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        records.read(manifest).collect()


def best_fit(lengths, capacity):
    """Room left in each sequence by best fit decreasing."""
    room = []
    for n in sorted(lengths, reverse=True):
        k = min((k for k, x in enumerate(room) if x >= n), key=room.__getitem__, default=None)
        if k is None:
            room.append(capacity - n)
        else:
            room[k] -= n
    return room


def test_packing_places_every_piece(docs, empty):
    found = packing.packed(docs, queries._file(queries.BYTE_BPE), P.PATTERN, 2, 256).collect()
    want = collections.Counter()
    for (i, _), ids in zip(rows(), ids_of(queries.BYTE_BPE)):
        ids = ids + [2]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want.update((i, k, a, z - a, zlib.crc32(packed_ids(ids[a:z]))) for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(places[-1]) <= 256
    assert len(held) <= len(best_fit([r.length for r in found], 256)) * 1.005 + 1
    assert packing.packed(empty, queries._file(queries.BYTE_BPE), P.PATTERN, 2).count() == 0


def test_sequences_hold_their_tokens(docs):
    pieces = packing.stored(packing.pieces(docs, queries._file(queries.BYTE_BPE), P.PATTERN, 2, 512, with_ids=True), "test")
    made = packing.sequences(packing.pack(pieces, 512)).collect()
    assert all(len(r.ids) == 4 * r.length <= 2048 for r in made)
    assert sum(r.length for r in made) == pieces.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("lengths", [[], [1024], [1] * 3000, [300] * 100, list(range(1, 1025)) * 4,
                                     random.Random(1).choices(range(330, 380), k=4000)])
def test_pack_block_is_close_to_best_fit(lengths):
    sequence, offset = packing.pack_block(lengths, 1024)
    held = collections.defaultdict(list)
    for s, o, n in zip(sequence, offset, lengths):
        held[s].append((o, n))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(places[-1]) <= 1024
    assert len(held) <= len(best_fit(lengths, 1024)) * 1.005 + 2


def test_byte_bpe_as_tiktoken(docs, empty):
    import tiktoken
    ranks = byte_bpe.read_ranks(queries.BYTE_RANKS)
    text = byte_bpe.tokenizer_json(ranks, P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in rows():
        ids = theirs.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(packed_ids(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, byte_bpe.round_trip(docs, text, P.PATTERN).collect())) == want
    assert byte_bpe.round_trip(empty, text, P.PATTERN).count() == 0
    encoded = byte_bpe.encode(docs, text, P.PATTERN, with_offsets=True)
    table = {(i, t) for i, t in rows()}
    pieces = byte_bpe.token_bytes(text)
    for r in encoded.collect():
        t = next(t or "" for i, t in table if i == r.doc_id and theirs.encode_ordinary(t or "") == r.ids)
        for k, a, z in zip(r.ids, r.starts, r.ends):  # each token's bytes lie in its characters' bytes
            assert pieces[k] in t[a:z].encode()
        assert "".join(byte_bpe.decode_stream(r.ids, pieces)) == t
    decoded = collections.Counter((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(encoded, text).collect())
    assert decoded == collections.Counter((i, (t or "").encode()) for i, t in rows())


def test_chunked_encoding_is_whole_text_encoding():
    r = random.Random(3)
    pool = "ab1 .\n\t'st\x1c\x85\xa0　​éÅÅΣİ²\U0001F600-_^]"
    for path in (queries.BYTE_BPE, queries.WORD_BPE):
        text = queries._file(path)
        own = chunked.ChunkEncoder(chunked.load(text), chunked.byte_level_rules(text, P.PATTERN))
        table = ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(1500)]
        for t, ids in zip(table, own.encode(table)):
            assert ids == packed_ids(own.tokenizer.encode(t, add_special_tokens=False).ids), repr(t)


def test_records_with_few_or_many_cached_chunks(docs):
    def found(cached):
        manifest = records.write(docs, queries._file(queries.WORD_BPE), P.PATTERN, 1, cached=cached)
        return sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in records.digest(records.read(manifest)).collect())

    assert found(8) == found(1_000_000)


def test_records_of_one_hot_id_are_many_files(spark):
    r = random.Random(1)
    table = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, words_of(r, r.randint(0, 30))) for i in range(600)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # small ranges would be put together again
    try:
        manifest = records.write(docs, queries._file(queries.WORD_BPE), P.PATTERN, end_id=1)
    finally:
        spark.conf.unset(key)
    files = manifest.collect()
    assert len(files) > 1 and sum(f.records for f in files) == 600
    assert any(f.first_id == f.last_id for f in files)  # one id alone
    found = sorted(records.read(manifest).collect(), key=lambda x: x.start)
    ids = [x.doc_id for x in found]
    assert [(i is not None, i or 0) for i in ids] == sorted((i is not None, i or 0) for i, _ in table)
    at = 0
    for x in found:
        assert x.start == at
        at += len(x.ids) // 4


# 5 exact deduplication

def brute_exact(table):
    groups = collections.defaultdict(list)
    for i, t in table:
        groups[re.sub(WHITE, "", t or "")].append((-len(t or ""), i is None, i))
    return groups


def test_exact_groups(docs, empty):
    groups = brute_exact(rows())
    want = collections.Counter()
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, m in enumerate(members):
            want[m[2], members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, exact.duplicates(docs).collect())) == want
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.duplicates(empty).count() == 0 and exact.deduplicate(empty).count() == 0


def test_exact_group_over_many_ranges(spark):
    table = [(i, "hot  text" if i % 2 else f"text {i}") for i in range(4000)] + [(9, "hot text ")] * 3
    found = exact.duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(8)).collect()
    hot = [r for r in found if r.group_size > 1]
    assert len(found) == 4003 and len(hot) == 2003 and {r.group_size for r in hot} == {2003}
    assert {r.keep_id for r in hot} == {1} and sum(r.kept for r in hot) == 1


def test_columns_may_repeat(spark):
    table = spark.createDataFrame([(1, "a b", 1), (2, "ab", 2), (3, "c", 3)], "doc_id long, text string, x int")
    twice = table.join(table.select(F.col("x").alias("x2")), F.col("x") == F.col("x2")).select("*", F.col("x2").alias("x"))
    assert exact.deduplicate(twice).columns == twice.columns and exact.deduplicate(twice).count() == 2


# 7 and 9 classifiers

def labelled(spark):
    r = random.Random(4)
    table, labels = [], []
    for i in range(600):
        body = [words_of(r, 12) for _ in range(r.randint(1, 8))]
        bad, rude = i % 4 == 0, i % 5 == 0
        if bad:
            body.insert(r.randrange(len(body) + 1), " | ".join(words_of(r, 40).upper().split()))
        if rude:
            for _ in range(2):
                body.insert(r.randrange(len(body) + 1), r.choice(["zorg", "blick", "krunt"]) + ", " + words_of(r, 3))
        table.append((i, " ".join(body), f"s{i % 3}"))
        labels.append((i, int(not bad), int(rude)))
    labels += [labels[0], (None, 1, 1), (9999, 1, 0), (1, None, None)]
    return (spark.createDataFrame(table, "doc_id long, text string, source string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_classifiers_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("quality is not null").collect()}
    for found, label, parts, held in ((passages.classify(docs, labels), "quality", 4, 2), (toxicity.score(docs, labels), "toxic", 3, 1)):
        table = found.collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in table)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in table)
        out = [r for r in table if r.held_out]
        assert sum(r.predicted == truth[r.doc_id][label] for r in out) / len(out) > 0.93, label
    kept = passages.keep(docs, labels, 0.5)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum((i in ids) == bool(truth[i].quality) for i in range(600)) > 560


def test_quality_stage_drops_what_the_operator_rejects(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"0.{i}") for i in range(10)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.quality_stage(spark, docs, str(tmp_path)).count() == 10  # no model: nothing is rejected
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(passages, "train", lambda *_: {})
    monkeypatch.setattr(passages, "scored", lambda rows, _, carry: rows.select(carry.alias("carry"), F.col("text").cast("double").alias("score")))
    verdict = {r.doc_id for r in queries.op7_attention_mil(spark, str(tmp_path)).where("predicted = 1").collect()}
    assert {r.doc_id for r in queries.quality_stage(spark, docs, str(tmp_path)).collect()} == verdict == {7, 8, 9}


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, "other") for i in range(2, 6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    found = [sorted(map(tuple, sample(d, labels, "toxic", {0: 10, 1: 10}, 1, 5).collect())) for d in (docs, docs.repartition(7))]
    assert found[0] == found[1] and [(i, k) for i, _, k in found[0]] == [(i, i % 2) for i in range(1, 6)]


@pytest.mark.parametrize("toxic", [1, 2, 3])
def test_toxicity_of_few_labels(spark, toxic):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    same = {r.id: r.half for r in spark.range(400).selectExpr("id", "cast(pmod(xxhash64(id, 'half'), 2) as int) as half").collect()}
    for half in (0, 1):  # all the toxic ones in one half of the hash
        rude = [i for i in ids if same[i] == half][:toxic]
        r = random.Random(8)
        table = [(i, words_of(r, 30) + (" zorg blick krunt zorg blick" if i in rude else "")) for i in ids[:120]]
        table.append((5000, words_of(r, 30) + " zorg blick krunt zorg blick"))
        docs = spark.createDataFrame(table, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i in rude)) for i in ids[:120]], "doc_id long, toxic int")
        score = {x.doc_id: x.score for x in toxicity.score(docs, labels).collect()}
        assert score[5000] > max(score[i] for i in ids[:120] if i not in rude)


def test_classifiers_on_awkward_rows(spark, docs, empty):
    base, labels = labelled(spark)
    for f in (passages.classify, toxicity.score):
        found = f(docs.select("doc_id", "text", "score", "label").unionByName(base.select("doc_id", "text"), True), labels).collect()
        assert len(found) == len(rows()) + 600 and all(r.score is not None and 0 <= r.score <= 1 for r in found)
        same = {r.score for r in found if r.doc_id == 5}
        assert len(same) <= 2  # the repeated row, and base's own document 5
        assert f(empty, labels).count() == 0
        unlearnt = f(docs, labels.limit(0)).collect()
        assert len(unlearnt) == len(rows()) and len({r.score for r in unlearnt}) == 1
    assert passages.keep(empty, labels, 0.5).count() == 0


def test_attention_gradient():
    r = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    x, y = r.normal(size=(8, passages.FEATURES)), np.array([1.0, 0, 1])
    model = passages.fit(x, counts, y)
    p, (*_, a, z) = passages.forward(model, x, counts)
    assert np.add.reduceat(a, [0, 3, 4]) == pytest.approx(1) and ((p > 0.5) == (y > 0.5)).all()


def test_passages_of_long_texts_are_all_described():
    text = words_of(random.Random(2), 50_001)
    x, counts = passages.described([text, "", "a"])
    assert counts.tolist() == [math.ceil(50_001 / passages.WORDS), 1, 1] and len(x) == counts.sum() and not x[-2].any()
    one, _ = passages.described([" ".join(text.split()[-1:])])
    assert np.allclose(one[0], x[counts[0] - 1])


# 8 host rules

def brute_rules(text):
    text = text or ""
    w = re.findall("[^ \t-\r]+", text)
    lines = [line for line in text.split("\n") if re.search("[^ \t-\r]", line)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(docs, empty):
    want = collections.Counter((i, *(n := brute_rules(t)), n[0] < 10 or 100 * n[4] > 20 * n[0]) for i, t in rows())
    found = host_rules.judged(docs).collect()
    assert collections.Counter(tuple(r)[:7] for r in found) == want
    assert all(not (r.kept and r.base_failed) for r in found)
    assert host_rules.judged(empty).count() == 0 and host_rules.keep(empty).count() == 0
    assert host_rules.keep(docs).columns == docs.columns
    assert host_rules.keep(docs).count() == sum(r.kept for r in found)


def test_bad_hosts_reject_their_documents(spark):
    good = "one two three four five six seven eight nine ten eleven"
    table = [(i, "bad" if i < 400 else f"h{i % 8}", "short" if i < 390 else good) for i in range(1200)] + [(2000, None, good), (2001, "new", "x")]
    docs = spark.createDataFrame(table, "doc_id long, source string, text string")
    found = {r.doc_id: r.kept for r in host_rules.judged(docs).collect()}
    assert not any(found[i] for i in range(400)) and all(found[i] for i in range(400, 1200)) and found[2000] and not found[2001]
    rates = {r.host: r.rate for r in host_rules.host_rates(host_rules.counted(docs, F.struct("doc_id"))).collect()}
    assert rates["bad"] > 0.5 > max(v for k, v in rates.items() if k not in ("bad", "new"))
    assert rates["new"] < 1  # one document says little
    assert host_rules.keep(docs).count() == sum(found.values())


@pytest.mark.parametrize("junk, rule", [("one two # three $ four five | six % seven eight", "symbols"), ("\n".join(f"again\nu{i} v{i} w{i}" for i in range(10)), "lines"),
                                        (" ".join(c * 30 for c in "abcdefghijklmnop"), "length")])
def test_each_rule_has_its_host_rate(spark, junk, rule):
    good = "one two three four five six seven eight nine ten eleven"
    table = [(i, "bad" if i < 300 else f"h{i % 8}", junk + " xx yy" if i < 290 else good) for i in range(1000)]
    docs = spark.createDataFrame(table, "doc_id long, source string, text string")
    found = host_rules.judged(docs).collect()
    assert not any(r.base_failed for r in found if r.doc_id >= 300)
    kept = {r.doc_id: r.kept for r in found}
    assert not any(kept[i] for i in range(300)) and all(kept[i] for i in range(300, 1000))
    rates = {r.host: r for r in host_rules.host_rates(host_rules.counted(docs, F.struct("doc_id"))).collect()}
    assert rates["bad"][f"rate_{rule}"] > 0.5 and all(r[f"rate_{rule}"] < 0.5 for h, r in rates.items() if h != "bad")


def test_toxicity_ratios_by_hand():
    """Highest windows, highest words anywhere, length and mean, of per-word ratios."""
    hasher = toxicity.Hasher()
    words = "bad ok ok bad ok ok ok bad ok ok ok ok"
    h = hasher(words)
    keys = np.sort(np.unique(h))
    value = {int(hasher("bad")[0]): 2.0, int(hasher("ok")[0]): -0.5}
    none = np.zeros(0, np.uint64)
    model = {"words": keys, "uni": np.array([value[int(k)] for k in keys], np.float32), "contexts": none, "gamma": np.zeros(0, np.float32),
             "pairs": none, "bi": np.zeros(0, np.float32), "unknown": 0.0}
    llr = [2.0 if w == "bad" else -0.5 for w in words.split()]
    windows = [max(sum(llr[i:i + k]) / k for i in range(len(llr) - k + 1)) for k in toxicity.WINDOWS]
    highest = [sum(sorted(llr)[-k:]) / k for k in toxicity.HIGHEST]
    got = toxicity.text_ratios(model, [h, hasher(""), hasher("bad")])
    assert np.allclose(got[0], [*windows, *highest, np.log(12), sum(llr) / 12])
    assert not got[1].any()
    assert np.allclose(got[2], [*[2.0 / k for k in (*toxicity.WINDOWS, *toxicity.HIGHEST)], 0.0, 2.0])


def test_toxicity_models_by_plain_counting(spark):
    """The ratio tables against Kneser-Ney by its formulas, from dictionaries of words."""
    r = random.Random(12)
    table = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 60))) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0), i % 2) for i in range(40)]
    counts = toxicity.bigram_counts(spark.createDataFrame(table, "doc_id long, text string, label int, half int"))
    hashed = lambda w: toxicity.START if w is None else int(toxicity.Hasher()(w)[0])
    for column in ("c", "c0"):
        found = toxicity.tables(counts, column)
        before = [collections.defaultdict(set), collections.defaultdict(set)]  # (u, w) -> different words before
        for _, text, label, half in table:
            words = [None, None, *text.split()]
            for v, u, w in zip(words, words[1:], words[2:]):
                if column == "c" or half == 0:
                    before[label][u, w].add(v)
        count = [{k: len(s) for k, s in b.items()} for b in before]
        joint = set(count[0]) | set(count[1])
        total = len(joint) + len({w for _, w in joint}) + 1
        for i, d in enumerate(toxicity.DISCOUNTS):
            model = toxicity.ratios(found, i, d)

            def uni(k, w):
                kinds = collections.Counter(x for _, x in count[k])
                n = sum(kinds.values())
                back = sum(min(c, d) for c in kinds.values()) / n
                shared = (sum(1 for _, x in joint if x == w) + 1) / total
                return max(kinds[w] - d, 0) / n + back * shared

            def bi(k, u, w):
                own = [c for (x, _), c in count[k].items() if x == u]
                gamma = sum(min(c, d) for c in own) / sum(own) if own else 1.0
                return (max(count[k].get((u, w), 0) - d, 0) / sum(own) if own else 0.0) + gamma * uni(k, w)

            for u, w in [*r.sample(sorted(joint, key=str), 25), (None, "a"), ("a", "vile"), ("never", "a"), ("a", "never")]:
                ku, kw = (np.array([hashed(x)], np.uint64) for x in (u, w))
                got, is_seen = toxicity.lookup(model["pairs"], model["bi"], toxicity.pair_key(ku, kw), 0)
                if not is_seen[0]:
                    got = toxicity.lookup(model["words"], model["uni"], kw, model["unknown"])[0] + toxicity.lookup(model["contexts"], model["gamma"], ku, 0)[0]
                assert got[0] == pytest.approx(math.log(bi(1, u, w) / bi(0, u, w)), abs=1e-5), (column, d, u, w)


def test_logistic_is_at_the_minimum():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 3))
    y = (x[:, 0] + r.normal(size=80) > 0).astype(float)
    b = toxicity.logistic(x, y)

    def loss(b):
        z = np.column_stack([x, np.ones(80)]) @ b
        return float((np.log1p(np.exp(z)) - y * z).sum() + 0.025 * b @ b)
    for i in range(4):
        for step in (1e-3, -1e-3):
            assert loss(b) < loss(b + step * np.eye(4)[i])
