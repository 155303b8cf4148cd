"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


EDGES_A_PART = 100_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of u is tied to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """u and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts)


def tied(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (node, component) after links (a, b) between its components, and nodes that are not in it. Only these links go through rounds."""
    more = cut(more)
    if more.isEmpty():
        return found
    new = components(more)
    old = found.join(new.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return old.unionByName(new.join(found, "node", "left_anti"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its least node.

    Each round's edges are written to the checkpoint folder. Hot nodes are reduced by partial
    aggregation; the joins on them can be split by adaptive execution. Rounds grow with the
    logarithm of the longest chain. The number of partitions follows the number of links, so that
    the rounds over a small graph leave few files. Self-links and repeated links are harmless; links with a
    null end are ignored; no links give no rows.
    """
    given = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges, loops, mark = given.where("u <> v"), given.where("u = v").select("u"), None
    parts = 1 + given.count() // EDGES_A_PART
    while True:
        new = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).head()
        if new == mark or new[0] == 0:
            break
        mark = new
        edges = cut(_small_star(_large_star(edges, parts), parts))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    alone = loops.withColumnRenamed("u", "node").join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
