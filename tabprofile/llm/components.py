"""Connected components of a link table by alternating star operations.

``large`` hangs every larger neighbour of a node, ``small`` every smaller one, under the
node's smallest neighbour; both keep the components, and in a few rounds each component is
a star around its smallest node.  Nodes' neighbours are only ever reduced by ``min`` (with
map-side combination) and joined back, so a node with very many links is never held as a
group; the joins are ones whose skewed keys Spark can split.  Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        joined = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
    return joined.where("u != v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) of every node that has a link;
    links are (a, b), in any direction, repeats allowed."""
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        edges = stored(_star(_star(edges, True), False), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
