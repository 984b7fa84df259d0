"""Best-fit packing by a linear grouping scheme (operator 6).

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt at random into
blocks of bounded size, and each block is packed on its own:

1. lengths above ``capacity / 8`` are sorted and cut into groups of equal cardinality; each
   length counts as the largest of its group, which leaves few sizes;
2. the best mix of configurations (multisets of sizes that fit one sequence) is found by
   column generation: a linear programme over configurations, priced by a knapsack;
3. each configuration is used as often as its rounded-down share says, and actual pieces
   take its places, the last place the longest piece that still fits;
4. large pieces left by the rounding, then small ones, go longest first to the open
   sequence they fill best.

A block of n pieces wastes at most a few sequences against one packing of everything, and
blocks need no view of each other, so the number of sequences in memory is bounded.

Defined results: null text is empty and gives the end id alone; repeated rows are pieces of
their own; equal lengths are taken in row order; null ids are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.chunked import CACHED, worker_encoder
from tabprofile.llm.common import portions, stored, texts

BLOCK = 32_768
GROUPS = 96


def pieces(docs: DataFrame, json_text: str, pattern: str, end_id: int, capacity: int = 1024,
           with_ids: bool = False, cached: int = CACHED) -> DataFrame:
    """Token pieces: row (unique), doc_id, piece, start, length, ids_crc32 and, on request,
    ids (little-endian unsigned 32-bit).  A text longer than ``capacity`` is cut so that
    only its first piece is shorter."""
    bc = docs.sparkSession.sparkContext.broadcast({"json": json_text, "pattern": pattern, "cached": cached})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        end, row = struct.pack("<I", end_id), TaskContext.get().partitionId() << 40
        for batch in batches:
            encoder = worker_encoder(bc.value)
            for b in portions(batch, 1, encoder.portion):
                out = [[] for _ in range(7)]
                for i, ids in enumerate(encoder.encode(b.column(1))):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        part = ids[4 * a:4 * z]
                        for held, x in zip(out, (row, i, k, a, z - a, zlib.crc32(part), part)):
                            held.append(x)
                        row += 1
                cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()))]
                cols[1] = b.column(0).take(cols[1])
                yield pa.RecordBatch.from_arrays(cols[:6 + with_ids], [
                    "row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 + with_ids])

    return texts(docs).mapInArrow(task, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                                  + ", ids binary" * with_ids)


def grouped_sizes(lengths, groups: int):
    """Lengths (descending) rounded up to the largest of their group of equal cardinality."""
    import numpy as np
    n = len(lengths)
    if not n:
        return lengths
    first = np.arange(n) // max(1, -(-n // groups)) * max(1, -(-n // groups))
    return lengths[first]


def configurations(sizes, demand, capacity: int, rounds: int = 2000):
    """The configuration programme min sum x, A x >= demand, by column generation.

    Returns (A, x): one column per basic configuration.  Every basis is feasible, so a
    stop after ``rounds`` still gives a usable mix."""
    import numpy as np
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        column, value = knapsack(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-6:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return np.rint(basis).astype(int), x


def knapsack(sizes, price, capacity: int):
    """The most valuable multiset of sizes within the capacity: (counts, value)."""
    import numpy as np
    best = np.zeros(capacity + 1)
    layers = []
    for s, p in zip(sizes, price):
        taken = np.zeros(capacity + 1, np.int8)
        if p > 0:
            for _ in range(capacity // s):
                more = best[:-s] + p
                better = more > best[s:] + 1e-12
                if not better.any():
                    break
                counts = np.where(better, taken[:-s] + 1, taken[s:])
                best[s:] = np.where(better, more, best[s:])
                taken[s:] = counts
        layers.append(taken)
    counts, room = np.zeros(len(sizes)), capacity
    for i in range(len(sizes) - 1, -1, -1):
        counts[i] = layers[i][room]
        room -= int(sizes[i]) * int(counts[i])
    return counts, float(counts @ price)


def pack_block(lengths, capacity: int, groups: int = GROUPS):
    """(sequence, offset) of each length."""
    import numpy as np
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    held: dict[int, list[int]] = defaultdict(list)  # rows by length
    for i in range(n - 1, -1, -1):
        held[int(lengths[i])].append(i)
    left = 0  # bit l: a row of length l is left
    for length in held:
        left |= 1 << length
    room: list[int] = []

    def take(most: int) -> int:
        """A longest row left of at most ``most`` tokens, or -1."""
        nonlocal left
        length = (left & ((1 << most + 1) - 1)).bit_length() - 1
        if length < 0:
            return -1
        i = held[length].pop()
        if not held[length]:
            left &= ~(1 << length)
        return i

    def put(i: int, where: int) -> None:
        sequence[i], offset[i] = where, capacity - room[where]
        room[where] -= int(lengths[i])

    large = -np.sort(-lengths[lengths > capacity // 8])
    if len(large):
        rounded = grouped_sizes(large, groups)
        sizes, demand = np.unique(rounded, return_counts=True)
        sizes, demand = sizes[::-1], demand[::-1]
        matrix, times = configurations(sizes, demand.astype(float), capacity)
        below = dict(zip(sizes.tolist(), [*sizes[1:].tolist(), capacity // 8]))
        order = sorted(range(len(times)), key=lambda j: -int(sizes[np.flatnonzero(matrix[:, j])[0]]) if matrix[:, j].any() else 0)

        def longest(most: int, above: int) -> bool:
            return (left & ((1 << most + 1) - 1)) >> above + 1 > 0

        for j in order:
            places = np.repeat(sizes, matrix[:, j]).tolist()  # descending
            for _ in range(int(times[j] + 1e-9)):
                if not places or not longest(places[0], below[places[0]]):
                    break  # its group is used up: the rest is for best fit
                where = len(room)
                room.append(capacity)
                for k, size in enumerate(places):
                    most = room[where] if k and k == len(places) - 1 else min(size, room[where])
                    if longest(most, below[size]):
                        put(take(most), where)
    open_by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for where, free in enumerate(room):
        open_by_room[free].append(where)
        rooms |= 1 << free
    while (i := take(capacity)) >= 0:
        size = int(lengths[i])
        fits = rooms >> size << size
        if fits:
            free = (fits & -fits).bit_length() - 1
            where = open_by_room[free].pop()
            if not open_by_room[free]:
                rooms &= ~(1 << free)
        else:
            where = len(room)
            room.append(capacity)
        put(i, where)
        open_by_room[room[where]].append(where)
        rooms |= 1 << room[where]
    return sequence, offset


def pack(rows: DataFrame, capacity: int = 1024, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to rows with ``row`` (unique) and ``length`` (1 to
    ``capacity``).  ``rows`` is read twice, so it should be a stored table."""
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, sequence_id long, offset long"

    def task(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = table.take(pc.sort_indices(table, [("row", "ascending")]))
        sequence, offset = pack_block(table["length"].to_numpy(), capacity, groups)
        first = np.int64(table["block"][0].as_py()) << np.int64(32)
        return table.drop_columns(["block"]).append_column("sequence_id", pa.array(sequence + first)) \
            .append_column("offset", pa.array(offset))

    return dealt.groupBy("block").applyInArrow(task, schema)


def packed(docs: DataFrame, json_text: str, pattern: str, end_id: int, capacity: int = 1024, cached: int = CACHED) -> DataFrame:
    """Pieces of all documents with their places.  ``cached`` chunks of text are kept in a
    worker, about 220 bytes each: more of them cost memory and save time."""
    return pack(stored(pieces(docs, json_text, pattern, end_id, capacity, cached=cached), "pieces"), capacity).drop("row")


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces with ids: sequence_id, ids, length.  A group is
    one sequence, so it is bounded by the capacity."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))),
                                         lambda x: x["ids"]))
    return placed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"), F.sum("length").alias("length"))
