"""Links inside hash buckets without all pairs of a large bucket.

Small buckets (at most ``SMALL`` members) give all their pairs. In a larger bucket every member
is first compared with a pivot, the member that shares most buckets with others. When the links
found so far are joined to components, only pairs across two components can still matter; those
are found exactly by comparing, block by block, the members outside the bucket's main component
with all its members. So no pair that shares a bucket is lost unless its ends are already
connected, and the blocks bound what one task holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Members of a small bucket, members of a block of a large one, pairs that are checked together.
SMALL, BLOCK, TOGETHER = 16, 512, 128


def sized(members: DataFrame) -> DataFrame:
    """(key, node, size) of the keys that several rows of (key, node) have. Hot keys are counted by partial sums, and their join can be split."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return members.join(sizes, "key")


def candidate_pairs(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (key, node, size): the first candidate pairs (a < b), and the members of large buckets."""
    small = shared.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("xs"))
    each = "flatten(transform(xs, (x, i) -> transform(slice(xs, i + 2, size(xs)), y -> struct(x as a, y as b))))"
    pairs = small.select(F.explode(F.expr(each)).alias("p")).select("p.a", "p.b")
    large = shared.where(F.col("size") > SMALL)
    centre = large.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = large.join(centre, "node").groupBy("key").agg(F.expr("min(struct(-weight, node)).node").alias("pivot"))
    stars = large.join(pivots, "key").where("pivot <> node").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    return pairs.unionByName(stars).distinct(), large.select("key", "node")


def rest_of_large(large: DataFrame, found: DataFrame, payload: Callable[[DataFrame], DataFrame], compare: Callable, check: Callable | None) -> DataFrame:
    """(a, b): components of ``found`` (node, component) that verified pairs of large buckets tie together; a node that is not in ``found`` is its own.

    ``payload`` turns (node) into (node, data binary). ``compare`` takes two lists of data and
    gives a boolean matrix; where it is true, ``check`` (if any) decides on lists of pairs of data. A
    block returns a spanning forest of what it ties, so no more rows than it has members.
    """
    named = large.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    per = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"))
    main = per.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.expr("max(struct(n, component)).component").alias("main"), F.sum("n").alias("all"),
        (F.sum("n") - F.max("n")).alias("outside"), F.bit_xor("members").alias("members"),
    ).where("parts > 1")
    # Buckets with the same members need only be compared once.
    main = main.groupBy("members", "all").agg(F.min("key").alias("key"), F.min("main").alias("main"), F.min("outside").alias("outside")).drop("members")
    open_rows = cut(named.join(main, "key"))
    if open_rows.isEmpty():
        return open_rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    rows = open_rows.join(payload(open_rows.select("node").distinct()), "node")
    block = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64(F.lit(n), "node"), block(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), block(n) - 1))
    outside = rows.where("component <> main").select("key", own("outside").alias("i"), every("all").alias("j"), F.lit(0).alias("side"), "node", "component", "data")
    inside = rows.select("key", every("outside").alias("i"), own("all").alias("j"), F.lit(1).alias("side"), "node", "component", "data")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(left) and len(right):
            of_left, of_right = left["component"].to_numpy(), right["component"].to_numpy()
            data_left, data_right = left["data"].tolist(), right["data"].tolist()
            ok = compare(data_left, data_right) & (of_left[:, None] != of_right[None, :])
            root = {c: c for c in {*of_left.tolist(), *of_right.tolist()}}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            maybe, at = np.argwhere(ok).tolist(), 0
            while at < len(maybe):
                some = [(x, y) for x, y in maybe[at : at + TOGETHER] if find(int(of_left[x])) != find(int(of_right[y]))]
                at += TOGETHER
                sure = [True] * len(some) if check is None or not some else check([data_left[x] for x, _ in some], [data_right[y] for _, y in some])
                for (x, y), yes in zip(some, sure):
                    c, d = find(int(of_left[x])), find(int(of_right[y]))
                    if yes and c != d:
                        root[c] = d
                        out.append((of_left[x], of_right[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return outside.unionByName(inside).groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def link(shared: DataFrame, verify: Callable[[DataFrame, DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame], compare: Callable, check: Callable | None = None) -> DataFrame:
    """(node, component) of all nodes with a verified link.

    ``shared`` has the materialised (key, node, size) of all buckets of two members or more.
    ``verify`` keeps the true pairs of (a, b); it also gets the nodes of large buckets.
    """
    pairs, large = candidate_pairs(shared)
    large = cut(large)
    found = components(verify(cut(pairs), large.select("node").distinct()))
    if large.isEmpty():
        return found
    more = rest_of_large(large, found, payload, compare, check)
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
