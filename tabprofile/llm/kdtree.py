"""Sharding by a k-d tree over metadata (operator 11).

A shard is a leaf of a tree.  Each node is split along its widest dimension (extent as a
share of the table's; of equal ones the first named) at the weighted median, the weight being
bytes: a node for n leaves gives floor(n / 2) / n of its bytes to the left.  Shards so hold
rows with like metadata, and near-equal bytes: a split is off by at most half a row.

A dimension is a 52-bit whole number: numbers and dates by their place between the least and
greatest value, strings by the six bytes after the prefix that all values share, null
below all.  Rows equal in it are told apart by a row number, so a value that a third of all
rows hold is split, too.  The medians of all nodes of a level are found together by
refinement: each pass adds up bytes in equal-width buckets of every node's open bracket,
combined in each task, and running sums choose the bucket with the median as the next
bracket.  Only the chosen bucket of each node, its extents and its cut reach the driver: as many
rows as there are nodes, at most ``MOST``.

The table is stored once with its codes and row numbers; passes read these columns alone.
Slots number the rows of a shard in stored order: the place inside a stored part plus the
rows of the parts before.

Defined results: a null text has size 1; null metadata sorts first; infinities stand at
the ends, NaN counts as null; a dimension without two values has extent 0; repeated rows are rows
of their own, and copies may part, as bytes alone decide; row numbers and so ties
follow the order in which Spark reads; an empty table gives an empty result, too few rows give
empty shards; all columns are kept in one struct, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprofile.llm.common import shared_path, stored

MOST = 100_000   # leaves of a tree; tables with a row a node are broadcast
BUCKETS = 65_536  # of all nodes of a level together
SCALE = 2 ** 52


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, (T.NumericType, T.BooleanType, T.TimestampType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    raise ValueError(f"no dimension can be made of {kind.simpleString()}")


def _codes(docs: DataFrame, dimensions: list[str]) -> list[Column]:
    """Each dimension as a long from 0 (null) to SCALE + 1; one pass for the bounds."""
    kinds = {c: docs.schema[c].dataType for c in dimensions}
    values = [F.col(c) if isinstance(kinds[c], T.StringType) else _number(F.col(c), kinds[c]) for c in dimensions]
    finite = [v if isinstance(kinds[c], T.StringType) else F.when(F.abs(v) != float("inf"), v) for c, v in zip(dimensions, values)]
    bounds = docs.agg(*[f(v) for v in finite for f in (F.min, F.max)]).first()
    out = []
    for i, (c, v) in enumerate(zip(dimensions, values)):
        low, high = bounds[2 * i], bounds[2 * i + 1]
        if isinstance(kinds[c], T.StringType) and low is not None:
            a, z = low.encode(), high.encode()
            shared = next((k for k, (x, y) in enumerate(zip(a, z)) if x != y), min(len(a), len(z)))
            low, high = (int.from_bytes(x[shared:shared + 6].ljust(6, b"\0"), "big") for x in (a, z))
            v = F.conv(F.hex(F.rpad(F.substring(F.encode(v, "UTF-8"), shared + 1, 6), 6, F.lit(b"\0"))), 16, 10).cast("double")
        if low is None or low == high:
            code = F.lit(1)
        else:  # halves first, as the difference of two large numbers may overflow
            share = (v / 2 - F.lit(float(low) / 2)) / F.lit(float(high) / 2 - float(low) / 2)
            code = 1 + F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * F.lit(float(SCALE)))
        out.append(F.when(v.isNull(), 0).otherwise(code).cast("long"))
    return out


def _small(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame(table, schema))  # at most MOST rows


def _beside(rows: DataFrame, table: list[tuple], schema: str, how: str) -> DataFrame:
    """``rows`` with their node's row of ``table`` (``own`` is the node); one row needs no join."""
    if len(table) > 1:
        return rows.join(_small(rows, table, schema), F.col("node") == F.col("own"), how)
    fields = [f.split() for f in schema.split(", ")]
    own = F.col("node") == table[0][0]
    values = [F.when(own, F.lit(v)).cast(kind).alias(name) for v, (name, kind) in zip(table[0], fields)]
    return (rows.where(own) if how == "inner" else rows).select("*", *values)


def _walk(rows: DataFrame, levels: list[list[tuple]]) -> DataFrame:
    """``rows`` with the node each has come to after ``levels`` of cuts."""
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    for cuts in levels:
        rows = _beside(rows, cuts, "own long, dim int, code long, last long", "left")
        c = F.get("codes", F.col("dim"))
        left = (c < F.col("code")) | ((c == F.col("code")) & (F.col("at") <= F.col("last")))
        rows = rows.withColumn(
            "node", F.when(F.col("own").isNull(), F.col("node")).when(left, 2 * F.col("node")).otherwise(2 * F.col("node") + 1))
        rows = rows.drop("own", "dim", "code", "last")
    return rows


def _cuts(rows: DataFrame, nodes: dict[int, int], buckets: int) -> list[tuple]:
    """(node, dimension, code, last row number on the left) of each node with leaves to part."""
    k = len(rows.select("codes").first()["codes"])
    extents = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[F.min(F.get("codes", F.lit(i))) for i in range(k)],
                                       *[F.max(F.get("codes", F.lit(i))) for i in range(k)])
    state = {}
    for r in extents.collect():  # a row a node
        n = nodes.get(r["node"], 1)
        if n > 1:
            low, high = r[2:2 + k], r[2 + k:]
            dim = max(range(k), key=lambda i: (high[i] - low[i], -i))
            state[r["node"]] = {"dim": dim, "goal": r["bytes"] * (n // 2) / n, "low": low[dim], "high": high[dim], "code": None, "before": 0}
    cuts = []
    while state:
        each = max(64, buckets // len(state))
        table = [(node, s["dim"], s["code"], s["low"], s["high"], (s["high"] - s["low"]) // each + 1, s["goal"], s["before"])
                 for node, s in state.items()]
        todo = "own long, dim int, code long, low long, high long, step long, goal double, before long"
        c = F.get("codes", F.col("dim"))
        key = F.when(F.col("code").isNull(), c).otherwise(F.when(c == F.col("code"), F.col("at")))
        inside = _beside(rows, table, todo, "inner").withColumn("key", key).where("key between low and high")
        sums = inside.groupBy("node", F.floor((F.col("key") - F.col("low")) / F.col("step")).alias("bucket"), "goal", "before").agg(
            F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"),
            F.min("at").alias("first"), F.max("at").alias("last"))
        w = Window.partitionBy("node").orderBy("bucket")
        sums = sums.withColumn("upto", F.col("before") + F.sum("bytes").over(w))
        hit = sums.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("bytes") < F.col("goal")))
        for r in hit.collect():  # a row a node
            s, before = state[r["node"]], r["upto"] - r["bytes"]
            if r["first"] == r["last"]:  # the row that holds the median goes where it's nearer to it
                code = r["least"] if s["code"] is None else s["code"]
                left = r["upto"] - s["goal"] <= s["goal"] - before
                cuts.append((r["node"], s["dim"], code, r["last"] if left else r["last"] - 1))
                del state[r["node"]]
            elif s["code"] is None and r["least"] == r["most"]:
                s.update(code=r["least"], low=r["first"], high=r["last"], before=before)
            else:
                s.update(low=r["least"], high=r["most"], before=before)
    return cuts


def shards(docs: DataFrame, dimensions: list[str], count: int | None = None, target_bytes: int | None = None,
           buckets: int = BUCKETS) -> DataFrame:
    """row (a struct of all columns), size (bytes of the text, plus 1), shard and slot.

    ``count`` shards, or as many as ``target_bytes`` asks for."""
    size = (F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1).cast("long")
    copy = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"),
                              F.array(*_codes(docs, dimensions)).alias("codes"), F.monotonically_increasing_id().alias("at")), "shards")
    rows = copy.select("size", "codes", "at")
    if count is None:
        count = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    if count > MOST:
        raise ValueError(f"{count} shards are asked for, at most {MOST} can be made")
    nodes, levels, shard_of = {1: count}, [], {}
    filled = not rows.isEmpty()
    while any(n > 1 for n in nodes.values()):
        if filled:
            levels.append(_cuts(_walk(rows, levels), nodes, buckets))
        nodes = {child: part for node, n in nodes.items()
                 for child, part in (((2 * node, n // 2), (2 * node + 1, n - n // 2)) if n > 1 else ((node, 1),))}
    for shard, node in enumerate(nodes):  # kept in order from left to right
        shard_of[node] = shard
    found = _walk(copy, levels).join(_small(rows, list(shard_of.items()), "leaf long, shard int"), F.col("node") == F.col("leaf"))
    return _slots(found.select("row", "size", "shard", "at", F.shiftright("at", 33).alias("part")))


def _slots(found: DataFrame) -> DataFrame:
    """Gapless numbers inside each shard; a window holds one shard's rows of one stored part."""
    counts = found.groupBy(F.col("shard").alias("s"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("s", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "slots")
    side = F.broadcast(offsets) if offsets.count() <= MOST else offsets
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    numbered = found.withColumn("place", place).join(side, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return numbered.select("row", "size", "shard", (F.col("place") + F.col("before")).alias("slot"))


def save(found: DataFrame, folder: str | None = None) -> str:
    """Write ``shards`` as Parquet files, a folder a shard; returns the folder."""
    folder = folder or shared_path(found.sparkSession, "sharded")
    found.write.partitionBy("shard").parquet(folder)
    return folder


def digests(found: DataFrame) -> DataFrame:
    """``shards`` in the numbers of the query."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return found.select("row.doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
