"""SimHash near-duplicates by anchor-point covering (operator 3).

A 64-bit fingerprint holds the majority bits of the XXH64 values of a text's word shingles.
Fingerprints within ``distance`` bits are linked, and components of links are the groups.

The 64 bits are cut into ``distance // 2 + 1`` segments (three for 4 bits), so two linked
fingerprints differ in at most one bit in some segment.  Over each segment lies a covering
code: a perfect Hamming code (on 15 bits of 21), whose words cover every pattern within
one bit, times all patterns of the other bits.  Its words are the anchors.  A fingerprint is
copied to every anchor within covering radius plus threshold (1 + 1 = 2 bits) of its
segment, about 14 of 2**17 anchors; the nearest anchor of one fingerprint of a link is
therefore also an anchor of the other one, and the two meet there.

Distinct fingerprints alone are copied.  An anchor's fingerprints are compared whole, by
following links from one to the next over those not yet reached, and one link per newly
reached fingerprint is given, so the links are a spanning forest and never all pairs.
An anchor with more than ``block`` fingerprints is first cut down by the same covering of
its fingerprints' other bits; that loses nothing, since two linked fingerprints that meet
at an anchor differ in at most one bit of one segment of those bits, too.

Defined results: null and word-less texts have fingerprint zero and are linked like any
other; repeated rows share their fingerprint; a component's id is its smallest non-null
doc_id (null if there is none); an empty table gives an empty result; other columns are
ignored, and filters keep them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import stored, texts
from tabprofile.llm.components import components

SEED = 42


def fingerprint(text: str, shingle: int) -> int:
    """The SimHash of one text; shingles are hashed and their bits counted in blocks."""
    import numpy as np
    from xxhash import xxh64_digest
    words = text.encode().lower().split()  # bytes: lower-cases A-Z alone, splits on the contract's white space
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n = max(1, len(words) - shingle + 1)
    span = min(shingle, len(words))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16384):
        upto = min(n, at + 16384)
        hashes = b"".join([xxh64_digest(joined[a:z - 1], SEED) for a, z in zip(starts[at:upto], starts[at + span:upto + span])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, *more: str) -> DataFrame:
    """doc_id, print (the fingerprint as a signed 64-bit number) of whole texts, and ``more``."""
    rows = texts(docs, *more)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *more)]

    def task(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            out = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *batch.columns[2:]], ["doc_id", "print", *more])

    return rows.mapInArrow(task, ", ".join([kinds[0], "print long", *kinds[1:]]))


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = distance // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def hamming_bits(bits: int) -> int:
    """Length of the longest perfect Hamming code within a segment: 2**r - 1."""
    return 2 ** ((bits + 1).bit_length() - 1) - 1


def flips(bits: int):
    """For each syndrome of the Hamming code, the changes of a segment's pattern that lead
    to the anchors within two bits: (changes, padded to equal length; how many)."""
    import itertools

    import numpy as np
    own = hamming_bits(bits)
    rows = [[] for _ in range(own + 1)]
    for k in range(3):
        for flipped in itertools.combinations(range(bits), k):
            syndrome = 0
            for b in flipped:
                syndrome ^= b + 1 if b < own else 0
            rows[syndrome].append(sum(1 << b for b in flipped))
    width = max(map(len, rows))
    return np.array([r + [0] * (width - len(r)) for r in rows], np.uint64), np.array([len(r) for r in rows])


def anchors(prints, first: int, bits: int):
    """(index into prints, anchor) pairs: every anchor within two bits of the segment."""
    import numpy as np
    table, count = flips(bits)
    word = prints >> np.uint64(first) & np.uint64((1 << bits) - 1)
    syndrome = np.zeros(len(prints), np.uint64)
    for b in range(hamming_bits(bits)):
        syndrome ^= (word >> np.uint64(b) & np.uint64(1)) * np.uint64(b + 1)
    syndrome = syndrome.astype(np.int64)
    all_words = word[:, None] ^ table[syndrome]
    real = np.arange(table.shape[1])[None, :] < count[syndrome][:, None]
    index = np.broadcast_to(np.arange(len(prints))[:, None], real.shape)
    return index[real], all_words[real]


def without(prints, first: int, bits: int):
    """The fingerprints with one segment cut out."""
    import numpy as np
    low = prints & np.uint64((1 << first) - 1)
    return low | (prints >> np.uint64(first + bits) << np.uint64(first) if first + bits < 64 else np.uint64(0))


def spanning_links(prints, distance: int):
    """(a, b) index pairs that connect what is linked, by following links from one
    fingerprint over those not reached yet."""
    import numpy as np
    rest = np.arange(len(prints))
    out = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            near = np.bitwise_count(prints[rest] ^ prints[a]) <= distance
            if near.any():
                reached = rest[near]
                out.append(np.stack([np.full(len(reached), a), reached], axis=1))
                queue.extend(reached.tolist())
                rest = rest[~near]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _copies(prints: DataFrame, distance: int) -> DataFrame:
    """Each distinct fingerprint at all its anchors: anchor, print, id."""
    cuts = segments(distance)

    def task(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            ids = batch.column(1).to_numpy()
            for at in range(0, len(values), 4096):
                part = values[at:at + 4096]
                for s, (first, bits) in enumerate(cuts):
                    index, anchor = anchors(part, first, bits)
                    key = (np.uint64(s) << np.uint64(60) | anchor).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(part[index].view(np.int64)), pa.array(ids[at:at + 4096][index])], ["anchor", "print", "id"])

    kind = prints.schema["id"].dataType.simpleString()
    return prints.select("print", "id").mapInArrow(task, f"anchor long, print long, id {kind}")


def _second(crowded: DataFrame, distance: int) -> DataFrame:
    """Rows of crowded anchors at the anchors of their other bits: anchor, also, print, id."""
    cuts = segments(distance)

    def task(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            keys = batch.column(0).to_numpy()
            values, ids = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            of = keys.view(np.uint64) >> np.uint64(60)
            for s, (first, bits) in enumerate(cuts):
                mine = np.flatnonzero(of == s)
                for at in range(0, len(mine), 4096):
                    rows = mine[at:at + 4096]
                    rest = without(values[rows], first, bits)
                    for s2, (first2, bits2) in enumerate(segments(distance, 64 - bits)):
                        index, anchor = anchors(rest, first2, bits2)
                        also = (np.uint64(s2 + 1) << np.uint64(60) | anchor).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[rows][index]), pa.array(also), pa.array(values[rows][index].view(np.int64)),
                             pa.array(ids[rows][index])], ["anchor", "also", "print", "id"])

    kind = crowded.schema["id"].dataType.simpleString()
    return crowded.select("anchor", "print", "id").mapInArrow(task, f"anchor long, also long, print long, id {kind}")


def links(prints: DataFrame, distance: int = 4, block: int = 4096) -> DataFrame:
    """Links (a, b) between ids; ``prints`` has distinct print and id."""
    kind = prints.schema["id"].dataType.simpleString()
    dealt = _copies(prints, distance)
    crowded = stored(dealt.groupBy("anchor").count().where(F.col("count") > block).select("anchor"), "crowded")
    if not crowded.isEmpty():
        dealt = dealt.join(crowded, "anchor", "left_anti").withColumn("also", F.lit(0).cast("long")).unionByName(
            _second(dealt.join(crowded, "anchor", "left_semi"), distance))
    else:
        dealt = dealt.withColumn("also", F.lit(0).cast("long"))

    def compare(batches):
        """Anchors of a sorted partition one after the other; the last one of a batch may
        go on in the next."""
        import numpy as np
        import pyarrow as pa
        held: list = []

        def found(cols):
            key, also, values, ids = cols
            values = values.view(np.uint64)
            bounds = np.flatnonzero((np.diff(key) != 0) | (np.diff(also) != 0)) + 1
            starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(key)]])
            many = ends - starts > 1
            out = [spanning_links(values[a:z], distance) + a for a, z in zip(starts[many].tolist(), ends[many].tolist())]
            pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy() for i in range(4)])
            ends = [(h[0][i], h[1][i]) for h, i in ((held[0], 0), (held[-1], -1))]
            if ends[0] == ends[1]:
                continue  # one anchor all along
            cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
            last = int(np.argmax((cols[0] == ends[1][0]) & (cols[1] == ends[1][1])))
            yield found([c[:last] for c in cols])
            held = [[c[last:] for c in cols]]
        if held:
            yield found([np.concatenate([h[i] for h in held]) for i in range(4)])

    ordered = dealt.select("anchor", "also", "print", "id").repartition("anchor", "also").sortWithinPartitions("anchor", "also")
    return ordered.mapInArrow(compare, f"a {kind}, b {kind}")


def rooted(prints: DataFrame, least, distance: int) -> tuple[DataFrame, DataFrame]:
    """print and root of each distinct print, and root and least of each component, the
    smallest value of the column ``least`` among its rows."""
    distinct = prints.groupBy("print").agg(F.min(least).alias("least"))
    nodes = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-prints")
    found = components(links(nodes, distance))  # node, root: of the nodes that have links
    roots = nodes.join(found, nodes.id == found.node, "left").select(
        "print", "least", F.coalesce("root", "id").alias("root"))
    return roots.select("print", "root"), roots.groupBy("root").agg(F.min("least").alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prints = stored(fingerprints(docs, shingle), "prints")
    roots, least = rooted(prints, F.col("doc_id"), distance)
    named = roots.join(least, "root").select(F.col("print").alias("of"), F.col("least").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return prints.join(named, prints.print == named.of).select("doc_id", hexed, "component_id")


def deduplicate(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with exactly one row of each component, the one with the smallest doc_id
    (null last), of several such rows any one; all columns as they were.

    Rows are told apart by a number stored with them, as ids can be null or repeated."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"), "row")
    prints = stored(fingerprints(keyed, shingle, "row"), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("k"), F.col("row").alias("r"))
    _, least = rooted(prints, first, distance)
    kept = least.select(F.col("least.r").alias("kept"))
    return rows.join(kept, rows.row == kept.kept, "left_semi").drop("row").toDF(*names)
