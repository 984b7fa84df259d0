"""Periodic run detection by string synchronising sets (operator 13).

A run is a stretch of consecutive words with smallest period q and at least 2 q (and 12)
words that no neighbouring word extends.  All runs of a text are found:

* periods up to 10 directly: words equal to the one q places on, in unbroken stretches;
* longer ones at dyadic scales t = 4, 8, 16, ..., each for periods of 3 t - 1 to 6 t - 2.
  Every stretch of t words has a hash.  A position is chosen if, among the hashes of the
  t + 1 stretches from it on, the smallest is the first or the last.  The choice depends on
  2 t words alone, so it is the same wherever they repeat, and each t neighbouring positions
  hold a chosen one unless their 3 t - 1 words have a period of t / 3 or less.  Chosen
  positions with equal 2 t words at a fitting distance propose that distance as a period;
* stretches of such small periods are left out of the choice: they are runs found before.
  A run all of whose chosen positions fall into them consists of two of them that touch, which
  propose the periods that bring their phases together.

Each proposal is extended over equal words in both directions and kept if it is a run, so
hashes only propose.  Texts of an Arrow slice are laid end to end with separators that equal
nothing, and each scale works on those long enough for its periods.

Defined results: null, empty and all-white texts have no words and no runs; repeated rows and
null ids are rows of their own; texts of any length are taken whole; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import SPACE, slices, texts

LEAST = 12   # words in a reported run
DIRECT = 10  # periods looked for directly
FIRST = 4    # the first scale


class Codes(dict):
    """A number for each distinct word."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def stretch(t, s: int, q: int) -> tuple[int, int]:
    """The widest [b, e) around ``s`` whose words equal those ``q`` places on, if they do at s."""
    import numpy as np
    e, b, step = s, s, 64
    while e < len(t) - q:
        z = min(e + step, len(t) - q)
        differ = t[e:z] != t[e + q:z + q]
        if differ.any():
            e += int(np.argmax(differ))
            break
        e, step = z, 4 * step
    step = 64
    while b > 0:
        a = max(0, b - step)
        differ = (t[a:b] != t[a + q:b + q])[::-1]
        if differ.any():
            b -= int(np.argmax(differ))
            break
        b, step = a, 4 * step
    return b, max(b, e)


class Runs:
    """Runs of one array of word codes: ``found`` maps (start, end) to the smallest period."""

    def __init__(self, t):
        self.t, self.found = t, {}

    def try_at(self, s: int, q: int) -> int:
        """Extend a proposal, note it if it is a run; the end of the equal words."""
        b, e = stretch(self.t, s, q)
        if e - b >= q:
            self.found.setdefault((b, e + q), q)  # a multiple of the period spans the same words
        return max(e, s + 1)

    def direct(self) -> None:
        import numpy as np
        t = self.t
        for q in range(1, DIRECT + 1):
            same = np.flatnonzero(t[q:] == t[:-q])
            if not len(same):
                continue
            breaks = np.flatnonzero(np.diff(same) != 1)
            starts, ends = same[np.r_[0, breaks + 1]], same[np.r_[breaks, len(same) - 1]] + 1
            # short runs of periods 1 and 2 matter as the small periods of scales 4 and 8
            long = ends - starts >= max(q, min(LEAST, 4 * q) - q)
            for b, e in zip(starts[long].tolist(), ends[long].tolist()):
                self.found.setdefault((b, e + q), q)

    def scale(self, t: int, size: int, hashes, doubled) -> None:
        """Periods of 3 t - 1 to 6 t - 2 in the first ``size`` words; ``hashes`` and
        ``doubled`` are those of the stretches of t and 2 t words."""
        import numpy as np
        low, high = 3 * t - 1, 6 * t - 2
        small = sorted((q, b, e) for (b, e), q in self.found.items() if 3 * q <= t and e - b >= t and e <= size)
        nothing = np.uint64(2 ** 64 - 1)
        own = hashes.copy()
        for _, b, e in small:
            own[b:e - t + 1] = nothing
        least, width = own, 1
        while width < t:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:-1], least[1:])
        n = len(least)
        chosen = np.flatnonzero((least != nothing) & ((own[:n] == least) | (own[t:t + n] == least)))
        key = doubled[chosen]
        order = np.argsort(key, kind="stable")
        key, place = key[order], chosen[order]
        proposals = []
        for lag in range(1, len(place)):
            far = place[lag:] - place[:-lag]
            near = (key[lag:] == key[:-lag]) & (far <= high)
            if not near.any():
                break
            near &= far >= low
            proposals.append(np.stack([far[near], place[:-lag][near]], 1))
        proposals.append(np.array(self.touching(small, low, high), np.int64).reshape(-1, 2))
        both = np.unique(np.concatenate(proposals), axis=0)
        periods, firsts = np.unique(both[:, 0], return_index=True)
        for q, places in zip(periods.tolist(), np.split(both[:, 1], firsts[1:])):
            i = 0
            while i < len(places):
                i = int(np.searchsorted(places, self.try_at(int(places[i]), q)))

    def touching(self, small, low: int, high: int) -> list[tuple[int, int]]:
        """Proposals (period, place) of neighbouring runs of one small period that touch."""
        t, out = self.t, []
        small = [x for x in small if x[2] - x[1] >= low]
        for (p, b, e), (p2, b2, e2) in zip(small, small[1:]):
            if p != p2 or b2 > e:
                continue
            shift = next((k for k in range(p) if (t[e - p - k:e - k] == t[b2:b2 + p]).all()), None)
            if shift is None:
                continue
            c = b2 - (e - p - shift)
            first = c + max(0, -(-(low - c) // p)) * p
            out += [(q, max(b, b2 - q)) for q in range(first, min(high, e - b, e2 - b2) + 1, p)]
        return out


def find_runs(codes: list) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each array of word codes."""
    import numpy as np

    def mixed(x, y):
        z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))

    order = sorted((i for i in range(len(codes)) if len(codes[i]) >= LEAST), key=lambda i: -len(codes[i]))
    found = [[] for _ in codes]
    if not order:
        return found
    parts, starts, at = [], [], 0
    for k, i in enumerate(order):
        parts += [codes[i], np.array([-1 - k], np.int32)]
        starts.append(at)
        at += len(codes[i]) + 1
    runs = Runs(np.concatenate(parts))
    runs.direct()
    hashes, t = runs.t.astype(np.uint64), 1
    sizes = np.array([len(codes[i]) for i in order])
    while True:
        fitting = int((sizes >= 2 * (3 * t - 1)).sum())
        if not fitting and t >= FIRST:
            break
        size = starts[fitting] if fitting < len(starts) else at
        if t >= FIRST:
            hashes = hashes[:size - t + 1]
        doubled = mixed(hashes[:-t], hashes[t:])
        if t >= FIRST:
            runs.scale(t, size, hashes, doubled)
        hashes, t = doubled, 2 * t
        if len(hashes) <= t:
            break
    starts = np.array(starts)
    for (b, e), q in runs.found.items():
        if e - b >= LEAST:
            k = int(np.searchsorted(starts, b, "right")) - 1
            found[order[k]].append((b - int(starts[k]), e - b, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(words: list[bytes], runs) -> bytes:
    """The words outside of repetitions: of each run only its first period stays."""
    if runs:
        kept = bytearray(b"\x01") * len(words)
        for start, length, period in runs:
            kept[start + period:start + length] = bytes(length - period)
        words = [w for w, k in zip(words, kept) if k]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period) and collapsed
    (the text's words without repetitions, joined by one space) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        import numpy as np
        import pyarrow as pa
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for b in slices(batch):
                number = Codes()
                words = [t.encode().split() for t in b.column(1).to_pylist()]
                codes = [np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for w in words]
                found = find_runs(codes)
                shown = pa.array([collapsed(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())
                listed = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], pa.list_(run))
                yield pa.RecordBatch.from_arrays([b.column(0), listed, shown], ["doc_id", "runs", "collapsed"])

    return texts(docs).mapInArrow(
        task, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length, of equal ones the first, then the shortest period; or null."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(best["start"].alias("start"), (-best["l"]).alias("length"), best["period"].alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` in numbers: the count, the longest run and hashes of the whole lists."""
    best = found.select("*", longest(F.col("runs")).alias("best"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth text by the hash of its id ends in a repetition.

    h is the CRC-32 of the id as text (null id: of the empty text), g = h div 10.  If 10 divides
    h, the words from a = g mod n on repeat with period 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    split = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    rows = texts(docs).select("doc_id", "text", h.alias("h")).select("*", F.when(F.col("h") % 10 == 0, split).alias("words"))
    rows = rows.select("*", F.when(F.size("words") > 0, F.size("words")).alias("n"), F.floor(F.col("h") / 10).alias("g"))
    rows = rows.select("*", (F.col("g") % F.col("n")).cast("int").alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get("words", F.col("a") + i % F.col("p")))
    repeated = F.array_join(F.concat(F.slice("words", 1, F.col("a")), tail), " ")
    return rows.select("doc_id", F.coalesce(F.when(F.col("n").isNotNull(), repeated), "text").alias("text"))
