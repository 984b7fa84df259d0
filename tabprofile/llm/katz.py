"""Katz backoff language model (operator 2), of bigrams.

    P(w)     = d(c(w)) c(w) / N                       seen words; one unknown word gets the rest
    P(w | u) = d'(c(u w)) c(u w) / c(u)               seen bigrams
             = alpha(u) P(w)                          others, by recursion; alpha = 1 if u is new

d is Katz's Good-Turing discount of counts up to ``K`` (:func:`discounts`).  alpha(u) is
(1 - sum of the seen P(w | u)) / (1 - sum of their P(w)), so that each P(. | u) sums to one
exactly over the training words and the unknown word.  A context whose followers all occur
more than K times has nothing discounted: its counts are divided by c(u) + 1 instead.

How the work is split.  Tokens stay in chunks of whole documents (about ``CHUNK`` bytes of
text), each a row with packed arrays.  A chunk asks for each of its distinct words, and
then distinct bigrams, once: requests go, packed, to buckets by hash; a bucket adds up its
chunks' training counts, keeps its part of the model's tables, and answers each chunk in the
order it asked.  So a frequent word or bigram costs one entry a chunk, buckets hold a
bounded number of entries as their number grows with the input, and neither the tables
nor a vocabulary ever pass the driver: it sees the counts of counts alone.  Bigrams are
dealt by their context, so a bucket knows all followers of a context; contexts with more
than ``HOT`` occurrences are dealt by context and a hash of the follower, and the parts of
their sums are added up in a table of their own, which chunks join by their frequent words.

Each document starts after a start mark, which is a context but no token, and ends with an
end token, which is counted.  Defined results: null text is empty and has the end token
alone; repeated rows are scored, and counted, each; with no training text N and V are 0 and
every token is the unknown word, with probability one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import remainder, shared_path, stored, texts

K = 5
CHUNK = 8 << 20
HOT = 1 << 20
WORD_ENTRIES, PAIR_ENTRIES = 400_000, 1_000_000  # entries a bucket holds
START, END = b"", b" "  # no word is empty or holds white space
PARTS, HELD = 7, 2


def slope(n: list[int]) -> float | None:
    """b of the line log Z(r) = a + b log r by least squares, or None with less than two r.

    Z(r) averages n[r] over the r on both sides that don't occur (Gale and Sampson's Simple
    Good-Turing): 2 n[r] / (next - previous), beyond the last one as far as before it."""
    import math
    rs = [r for r in range(1, K + 2) if n[r]]
    if len(rs) < 2:
        return None
    ends = [0, *rs, 2 * rs[-1] - rs[-2]]
    x, y = [math.log(r) for r in rs], [math.log(2 * n[r] / (ends[i + 2] - ends[i])) for i, r in enumerate(rs)]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((p - mx) * (q - my) for p, q in zip(x, y)) / sum((p - mx) ** 2 for p in x)


def discounts(n: list[int]) -> list[float]:
    """d(0) to d(K) from n[r], the number of entries that occur r times, r = 0 to K + 1.

    d(r) = (r* / r - A) / (1 - A), r* = (r + 1) n[r+1] / n[r], A = (K + 1) n[K+1] / n[1].
    From the first r on whose d leaves (0, 1), or for all r if A does or an n[r] is 0, r* and
    A come from smoothed counts of counts, n[r] ~ r^b (:func:`slope`), as Simple Good-Turing
    changes over once and for all; b < -1 keeps every d in (0, 1).  Only without such a b
    (fewer than two different r, or counts that don't fall) absolute discounting by
    n[1] / (n[1] + 2 n[2]) takes the place of the smoothed ones."""
    b = slope(n)
    if b is not None and b < -1:
        a = (K + 1) ** (b + 1)
        smooth = [((1 + 1 / r) ** (b + 1) - a) / (1 - a) for r in range(1, K + 1)]
    else:
        cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        smooth = [1 - cut / r for r in range(1, K + 1)]
    dealt = []
    if all(n[1:K + 2]) and (a := (K + 1) * n[K + 1] / n[1]) < 1:
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
            if not 0 < d < 1:
                break
            dealt.append(d)
    return [0.0, *dealt, *smooth[len(dealt):]]


@dataclass
class Unigrams:
    """What one row of totals says of the words: P(w) from the count alone."""
    tokens: int
    words: int
    counts: list[int]  # n[r]
    d: list[float] = field(default_factory=list)
    unknown: float = 1.0
    scale: float = 1.0

    def __post_init__(self):
        self.d = discounts(self.counts)
        if self.tokens:
            self.unknown = sum((1 - self.d[r]) * r * self.counts[r] for r in range(1, K + 1)) / self.tokens
            if self.unknown <= 0:  # no rare words: one more occurrence, of the unknown word
                self.scale = self.tokens / (self.tokens + 1)
                self.unknown = 1 - self.scale

    def p(self, c):
        import numpy as np
        small = np.asarray(self.d)[np.minimum(c, K)]
        return np.where(c > 0, np.where(c > K, 1.0, small) * c * (self.scale / max(self.tokens, 1)), self.unknown)


def squeeze(a) -> bytes:
    """An integer array as zstandard-compressed bytes, equal bytes of the numbers together."""
    import numpy as np
    import zstandard
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unsqueeze(b: bytes, kind: str):
    import numpy as np
    import zstandard
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(b: bytes) -> list[bytes]:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(b).split(b"\n")


def spread(a):
    """64-bit integers mixed, for dealing by remainder."""
    import numpy as np
    a = np.asarray(a).astype(np.uint64)
    a = (a ^ a >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ a >> np.uint64(32)


def chunks(docs: DataFrame, parts: int, held: int) -> DataFrame:
    """A stored row per chunk: chunk (unique), docs and their lengths, held flags, tokens as
    local word numbers, the local words (0 the start mark, 1 the end), and their counts in
    training documents."""
    rows = texts(docs).withColumn("held", remainder("doc_id", parts) == held)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def task(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 24
        ids, lengths, flags, tokens, size, local = [], [], [], [], 0, {START: 0, END: 1}

        def row():
            all_tokens = np.concatenate(tokens)
            trained = np.repeat(~np.array(flags), lengths)
            counts = np.bincount(all_tokens[trained], minlength=len(local))
            counts[0] = len(flags) - sum(flags)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([[i.as_py() for i in ids]], pa.list_(ids[0].type)),
                pa.array([lengths], pa.list_(pa.int32())), pa.array([flags], pa.list_(pa.bool_())),
                pa.array([squeeze(all_tokens.astype("<i4"))], pa.binary()), pa.array([pack_words(list(local))], pa.binary()),
                pa.array([squeeze(counts.astype("<i8"))], pa.binary()), pa.array([len(local)], pa.int64())],
                ["chunk", "docs", "lengths", "held", "tokens", "words", "counts", "n"])

        for batch in batches:
            for doc_id, text, flag in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = text.as_py().encode().lower().split()  # lower-cases A-Z alone
                words.append(END)
                tokens.append(np.array([local.setdefault(w, len(local)) for w in words], np.int32))
                ids.append(doc_id)
                lengths.append(len(words))
                flags.append(flag.as_py())
                size += len(text.as_buffer())
                if size >= CHUNK:
                    yield row()
                    number += 1
                    ids, lengths, flags, tokens, size, local = [], [], [], [], 0, {START: 0, END: 1}
        if ids:
            yield row()

    return stored(rows.mapInArrow(task, f"chunk long, docs array<{kind}>, lengths array<int>, held array<boolean>, "
                                        "tokens binary, words binary, counts binary, n long"), "chunks")


def word_table(chunked: DataFrame) -> tuple[DataFrame, Unigrams]:
    """The unigram tables, partitioned by kind, and their totals.

    kind 'model': words, counts and ids of a bucket; kind 'answer': for a chunk, the ids and
    counts of the words it asked this bucket for, in the chunk's order."""
    import numpy as np
    spark = chunked.sparkSession
    buckets = int(-(-(chunked.agg(F.sum("n")).first()[0] or 0) // WORD_ENTRIES)) or 1

    def ask(batches):
        import pyarrow as pa
        for batch in batches:
            for chunk, words, counts in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words, counts = unpack_words(words), unsqueeze(counts, "<i8")
                dealt = bucket_of(words, buckets)
                for b in np.unique(dealt).tolist():
                    mine = np.flatnonzero(dealt == b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int64()), pa.array([chunk], pa.int64()),
                         pa.array([pack_words([words[i] for i in mine.tolist()])], pa.binary()),
                         pa.array([squeeze(counts[mine])], pa.binary())], ["bucket", "chunk", "words", "counts"])

    def answer(table):
        import pyarrow as pa
        b = table["bucket"][0].as_py()
        asked = sorted(zip(table["chunk"].to_pylist(), table["words"].to_pylist(), table["counts"].to_pylist()), key=lambda x: x[0])
        known: dict[bytes, int] = {}
        places = []
        for _, words, _ in asked:
            words = unpack_words(words)
            places.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        total = np.zeros(len(known), np.int64)
        for at, (_, _, counts) in zip(places, asked):
            total[at] += unsqueeze(counts, "<i8")
        ids = np.arange(len(known), dtype=np.int64) * buckets + b
        token = np.ones(len(known), bool)
        if START in known:
            token[known[START]] = False
        seen = total[token & (total > 0)]
        n = np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[:K + 2]
        out = [("model", -1, pack_words(list(known)), squeeze(ids), squeeze(total), n.tolist(), int(seen.sum()), len(seen))]
        out += [("answer", c, None, squeeze(ids[at]), squeeze(total[at]), None, None, None) for at, (c, _, _) in zip(places, asked)]
        cols = list(zip(*out))
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array([b] * len(out), pa.int64())],
                        names=["kind", "chunk", "words", "ids", "counts", "n", "tokens", "distinct", "bucket"])

    requests = chunked.select("chunk", "words", "counts").mapInArrow(ask, "bucket long, chunk long, words binary, counts binary")
    path = shared_path(spark, "unigrams")
    schema = "kind string, chunk long, words binary, ids binary, counts binary, n array<long>, tokens long, distinct long, bucket long"
    requests.groupBy("bucket").applyInArrow(answer, schema).write.partitionBy("kind").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    s = table.where("kind = 'model'").agg(F.sum("tokens"), F.sum("distinct"), *[F.sum(F.col("n")[r]) for r in range(K + 2)]).first()
    return table, Unigrams(s[0] or 0, s[1] or 0, [x or 0 for x in s[2:]])


def bucket_of(words: list[bytes], buckets: int):
    import numpy as np
    from xxhash import xxh3_64_intdigest
    return (np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)


class Chunk:
    """A chunk's documents with the model's ids and counts of its words."""

    def __init__(self, row: dict, answers: list[dict], buckets: int):
        import numpy as np
        words = unpack_words(row["words"])
        dealt = bucket_of(words, buckets)
        self.ids, self.counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for a in answers:
            mine = dealt == a["bucket"]
            self.ids[mine], self.counts[mine] = unsqueeze(a["ids"], "<i8"), unsqueeze(a["counts"], "<i8")
        self.docs, self.held = row["docs"], np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.tokens = unsqueeze(row["tokens"], "<i4").astype(np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate([[0], self.tokens[:-1]])
        before[starts] = 0
        # the distinct bigrams, as local numbers, and which one each token ends
        pairs, self.pair = np.unique(before * len(words) + self.tokens, return_inverse=True)
        self.u, self.w = pairs // len(words), pairs % len(words)
        self.trained = np.bincount(self.pair[~np.repeat(self.held, self.lengths)], minlength=len(pairs))

    def dealt(self, buckets: int):
        """(bucket, key, order) of the distinct bigrams: order sorts by bucket and key."""
        import numpy as np
        u, w = self.ids[self.u], self.ids[self.w]
        parts = np.uint64(1) + (self.counts[self.u] // HOT).astype(np.uint64)
        bucket = (spread(spread(u) + spread(w) % parts) % np.uint64(buckets)).astype(np.int64)
        return bucket, u, w, np.lexsort((w, u, bucket))


def pair_table(chunked: DataFrame, words: DataFrame, uni: Unigrams, word_buckets: int) -> tuple[DataFrame, list[float], int]:
    """The bigram tables, partitioned by kind, the discounts, and the number of buckets.

    kind 'model': u, w, counts of a bucket, u and w being ids of the unigram table; kind
    'answer': for a chunk, the training counts of the bigrams it asked this bucket for, and
    of each of their contexts the number of seen followers by count 1 to K, and P(w) summed
    over all seen followers; kind 'part': the same for the bucket's parts of hot contexts."""
    import numpy as np
    spark = chunked.sparkSession
    entries = chunked.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-entries // PAIR_ENTRIES))

    def ask(key, own, answers):
        import pyarrow as pa
        for row in own.to_pylist():
            c = Chunk(row, answers.to_pylist(), word_buckets)
            bucket, u, w, order = c.dealt(buckets)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in range(buckets):
                mine = order[cuts[b]:cuts[b + 1]]
                if len(mine):
                    out.append((b, row["chunk"], squeeze(np.diff(u[mine], prepend=0)), squeeze(w[mine]), squeeze(c.trained[mine]),
                                squeeze(c.counts[c.w[mine]]), np.unique(u[mine][c.counts[c.u[mine]] >= HOT])))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
            return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                            names=["bucket", "chunk", "u", "w", "counts", "singles", "hot"])

    def answer(table):
        import pyarrow as pa
        b = table["bucket"][0].as_py()
        asked = table.sort_by("chunk").to_pylist()
        us = [np.cumsum(unsqueeze(a["u"], "<i8")) for a in asked]
        ws = [unsqueeze(a["w"], "<i8") for a in asked]
        u, w = np.concatenate(us), np.concatenate(ws)
        order = np.lexsort((w, u))
        su, sw = u[order], w[order]
        new = np.concatenate([[True], (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])])
        place = np.empty(len(u), np.int64)
        place[order] = np.cumsum(new) - 1
        at = order[new]
        total = np.bincount(place, np.concatenate([unsqueeze(a["counts"], "<i8") for a in asked])).astype(np.int64)
        singles = np.concatenate([unsqueeze(a["singles"], "<i8") for a in asked])[at]
        contexts, of = np.unique(u[at], return_inverse=True)
        by_count = np.stack([np.bincount(of, total == r, len(contexts)) for r in range(1, K + 1)], axis=1).astype(np.int32)
        mass = np.bincount(of, np.where(total > 0, uni.p(singles), 0), len(contexts))
        n = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[:K + 2]
        n[0] = 0
        seen = total > 0
        out = [("model", -1, squeeze(u[at][seen]), squeeze(w[at][seen]), squeeze(total[seen]), None, None, n.tolist(), None)]
        first = 0
        split = np.unique(np.concatenate([a["hot"] for a in asked])).astype(np.int64)
        if len(split):
            c = np.searchsorted(contexts, split)
            out.append(("part", -1, None, None, None, None, None, None,
                        [{"u": x, "followers": f, "mass": m} for x, f, m in zip(split.tolist(), by_count[c].tolist(), mass[c].tolist())]))
        for a, own in zip(asked, us):
            mine = place[first:first + len(own)]
            first += len(own)
            c = np.searchsorted(contexts, np.unique(own))
            out.append(("answer", a["chunk"], None, None, squeeze(total[mine]), squeeze(by_count[c].reshape(-1)), squeeze(mass[c]), None, None))
        kinds = [pa.string(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.list_(pa.struct(
            [("u", pa.int64()), ("followers", pa.list_(pa.int64())), ("mass", pa.float64())]))]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds)] + [pa.array([b] * len(out), pa.int64())],
                        names=["kind", "chunk", "u", "w", "counts", "followers", "mass", "n", "parts", "bucket"])

    own = chunked.groupBy("chunk")
    requests = own.cogroup(words.where("kind = 'answer'").select("chunk", "bucket", "ids", "counts").groupBy("chunk")).applyInArrow(
        ask, "bucket long, chunk long, u binary, w binary, counts binary, singles binary, hot array<long>")
    path = shared_path(spark, "bigrams")
    schema = "kind string, chunk long, u binary, w binary, counts binary, followers binary, mass binary, n array<long>, "
    schema += "parts array<struct<u: long, followers: array<long>, mass: double>>, bucket long"
    requests.groupBy("bucket").applyInArrow(answer, schema).write.partitionBy("kind").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    n = table.where("kind = 'model'").agg(*[F.sum(F.col("n")[r]) for r in range(K + 2)]).first()
    return table, discounts([x or 0 for x in n]), buckets


def hot_contexts(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunk, hot_u, hot_followers, hot_mass: whole sums of the hot contexts of each chunk."""
    import numpy as np

    def task(batches):
        import pyarrow as pa
        for batch in batches:
            for chunk, ids, counts in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                found = unsqueeze(ids, "<i8")[unsqueeze(counts, "<i8") >= HOT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), pa.array(found)], ["chunk", "hot_u"])

    part = pairs.where("kind = 'part'").select(F.explode("parts").alias("p")).select("p.*")
    whole = part.groupBy("u").agg(F.array(*[F.sum(F.col("followers")[r]) for r in range(K)]).alias("hot_followers"),
                                  F.sum("mass").alias("hot_mass"))
    wanted = words.where("kind = 'answer'").select("chunk", "ids", "counts").mapInArrow(task, "chunk long, hot_u long")
    return wanted.join(whole, wanted.hot_u == whole.u).drop("u")


def chunk_scores(c: Chunk, answers: list[dict], hot: list[dict], uni: Unigrams, d: list[float], buckets: int):
    """(known tokens, base score, score) of each document of a chunk."""
    import numpy as np
    bucket, u, w, order = c.dealt(buckets)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    total = np.zeros(len(u), np.int64)
    followers, mass = np.zeros((len(c.ids), K)), np.zeros(len(c.ids))
    local = np.argsort(c.ids)
    for a in answers:
        mine = order[cuts[a["bucket"]]:cuts[a["bucket"] + 1]]
        total[mine] = unsqueeze(a["counts"], "<i8")
        at = local[np.searchsorted(c.ids[local], np.unique(u[mine]))]
        followers[at] = unsqueeze(a["followers"], "<i4").reshape(-1, K)
        mass[at] = unsqueeze(a["mass"], "<f8")
    for a in hot:
        at = local[np.searchsorted(c.ids[local], a["hot_u"])]
        followers[at], mass[at] = a["hot_followers"], a["hot_mass"]
    d = np.asarray(d)
    r = np.arange(1, K + 1)
    freed = followers @ ((1 - d[1:]) * r)
    occurs = c.counts.astype(float)  # each occurrence of a word in training has one follower
    below = np.where(freed > 0, occurs, occurs + 1)  # nothing discounted: one more for the rest
    rest = np.where(freed > 0, freed, 1.0)
    alpha = np.where(occurs > 0, rest / below / np.maximum(1 - mass, 1e-300), 1.0)
    single = uni.p(c.counts)
    p = np.where(total > 0, np.where(total > K, 1.0, d[np.minimum(total, K)]) * total / below[c.u], alpha[c.u] * single[c.w])
    of = np.repeat(np.arange(len(c.lengths)), c.lengths)
    seen = c.counts[c.tokens]
    base = np.log10((seen + 1) / (uni.tokens + uni.words + 1))
    n = len(c.lengths)
    return (np.bincount(of, seen > 0, n).astype(np.int64), np.bincount(of, base, n), np.bincount(of, np.log10(p)[c.pair], n))


def scores(docs: DataFrame, parts: int = PARTS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row;
    the model learns from rows whose crc32 remainder by ``parts`` isn't ``held``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunked = chunks(docs, parts, held)
    words, uni = word_table(chunked)
    word_buckets = int(-(-(chunked.agg(F.sum("n")).first()[0] or 0) // WORD_ENTRIES)) or 1
    pairs, d, buckets = pair_table(chunked, words, uni, word_buckets)

    def score(key, own, answers):
        import pyarrow as pa
        answers = answers.to_pylist()
        for row in own.to_pylist():
            c = Chunk(row, [a for a in answers if a["ids"] is not None], word_buckets)
            known, base, full = chunk_scores(c, [a for a in answers if a["followers"] is not None],
                                             [a for a in answers if a["hot_u"] is not None], uni, d, buckets)
            n = len(c.docs)
            return pa.table([pa.array(c.docs, own.schema.field("docs").type.value_type), pa.array(c.held), pa.array(c.lengths),
                             pa.array(known), pa.array([uni.tokens] * n, pa.int64()), pa.array(base), pa.array(full)],
                            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = words.where("kind = 'answer'").select("chunk", "bucket", "ids", "counts") \
        .unionByName(pairs.where("kind = 'answer'").select("chunk", "bucket", "counts", "followers", "mass"), True) \
        .unionByName(hot_contexts(words, pairs), True)
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
