"""Links inside the buckets of a join, found where a bucket lies.

The members of a bucket come with their data. All are compared with its first; whoever that leaves
out is compared with all others where these are few. In a larger bucket it is compared with
further leaders, each the first that is still left out. A bucket of over ``GROUP`` members is dealt
into parts; the leaders of its parts are then compared in the same way, so no task holds
more than a part and the work of a bucket grows with its members and leaders, not with its square.

In a bucket that unlike members may share, at most ``LEADERS`` are tried; the rest is returned.

This connects all that can be connected only in buckets that are ``settled``. In a larger one a follower of a leader
does not meet those that this leader left out, and members of different parts do not meet; such pairs
are left to an exact comparison across components (``buckets.rest_of_large``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

#: Members of a part of a bucket, leaders that are tried, comparisons up to which whoever is left out meets all others, rows that are worked on together.
GROUP, LEADERS, FEW, TOGETHER = 4096, 32, 1 << 12, 1 << 14
LINK, LEADER, REST = range(3)
FOUND = "kind int, key long, a long, b long, data binary"
#: What is made of the data and the nodes of some members: a comparison of members by their places.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]
Prepare = Callable[[pa.Array, np.ndarray], Alike]


def ties(n: int, starts: np.ndarray, patient: np.ndarray, alike: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``n`` members in buckets that begin at ``starts``: linked pairs of places, the places of leaders, and those of members that are left when ``LEADERS`` were tried. ``patient`` buckets try as many as it takes."""
    size = np.diff(np.append(starts, n))
    bucket = np.repeat(np.arange(len(starts)), size)
    others = np.flatnonzero(np.arange(n) != starts[bucket])
    near = alike(starts[bucket[others]], others)
    links = [np.column_stack([starts[bucket[others[near]]], others[near]])]
    leaders, rest = [starts], []
    loose = others[~near]
    loose = loose[size[bucket[loose]] > 2]  # in a bucket of two there is nobody else
    many = np.bincount(bucket[loose], minlength=len(starts))
    few = many * size <= FEW
    mine = loose[few[bucket[loose]]]
    leaders.append(mine)
    for at in range(0, len(mine), 1 << 14):  # each with all others of its bucket, once
        some = mine[at : at + (1 << 14)]
        width = size[bucket[some]] - 1
        a = np.repeat(some, width)
        b = np.repeat(starts[bucket[some]] + 1, width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        left_out = np.zeros(n, dtype=bool)
        left_out[loose] = True
        once = (a < b) | ((a > b) & ~left_out[b])
        a, b = a[once], b[once]
        near = alike(a, b)
        links.append(np.column_stack([a[near], b[near]]))
    for k in np.flatnonzero((many > 0) & ~few).tolist():
        mine = loose[bucket[loose] == k]
        tried = 1
        while len(mine) and (patient[k] or tried < LEADERS):
            lead, mine, tried = mine[0], mine[1:], tried + 1
            near = alike(np.full(len(mine), lead), mine)
            links.append(np.column_stack([np.full(int(near.sum()), lead), mine[near]]))
            leaders.append(np.array([lead]))
            mine = mine[~near]
        if len(mine):
            rest.append(mine)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(links), np.sort(np.concatenate(leaders)), np.concatenate(rest) if rest else none


def whole_buckets(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Tables of some ``TOGETHER`` rows of sorted batches. No bucket, rows that agree in the columns ``names``, is in two of them."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < TOGETHER:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        # The last bucket may go on in the next batch.
        same = np.logical_and.reduce([(c := rows.column(name).to_numpy()) == c[-1] for name in names])
        whole = int(np.argmax(same))
        if whole:
            yield rows.slice(0, whole)
        held, count = rows.slice(whole).to_batches(), rows.num_rows - whole
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _round(members: DataFrame, parts: int, patient: bool | int, prepare: Prepare) -> DataFrame:
    """``FOUND`` rows of (home, key, part, split, weight, node, data): links, the leaders of buckets that are split, and what is left."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, part, split, node = (rows.column(c).to_numpy() for c in ("key", "part", "split", "node"))
        data = rows.column("data").combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        wait = np.ones(len(starts), dtype=bool) if patient is True else (key[starts] & patient) != 0
        links, leaders, rest = ties(len(node), starts, wait, prepare(data, node))
        leaders = leaders[split[leaders]]
        if len(links):  # a pair that meets in several buckets is one link
            ends = np.sort(np.column_stack([node[links[:, 0]], node[links[:, 1]]]), axis=1)
            links = links[np.unique(ends, axis=0, return_index=True)[1]]
        kind = np.concatenate([np.full(len(links), LINK), np.full(len(leaders), LEADER), np.full(len(rest), REST)]).astype(np.int32)
        at = np.concatenate([links[:, 0], leaders, rest])
        to = np.concatenate([links[:, 1], leaders, rest])
        held = pa.concat_arrays([pa.nulls(len(links), pa.binary()), data.take(pa.array(leaders)), pa.nulls(len(rest), pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key[at]), pa.array(node[at]), pa.array(node[to]), held], names=["kind", "key", "a", "b", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, "key", "part"):
            yield from work(rows)
        give_back()

    # Buckets of one home lie together, so that pairs that meet in several of them are compared once.
    dealt = members.repartition(parts, "home", "part").sortWithinPartitions("home", "key", "part", F.desc("weight"), "node")
    return dealt.select("key", "part", "split", "node", "data").mapInArrow(run, FOUND)


def leader_links(members: DataFrame, parts: int, prepare: Prepare, patient: bool | int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of buckets (key, home, node, size, weight, data), and (key, node) of what leaders left over.

    ``home`` is any number that buckets with the same members in part are likely to share. Members of more weight lead. ``patient`` says which buckets try as many leaders as it takes: all, or those whose key has this bit. Leaders of
    the parts of a bucket meet in further rounds, until they are one part or no fewer than before.
    """
    links = rest = before = None  # an empty DataFrame made of a list would keep Python workers of its own alive
    while True:
        many = F.ceil(F.col("size") / GROUP)
        part = F.pmod(F.xxhash64(F.lit(0 if before is None else before), "node"), many)
        found = written(_round(members.select("home", "key", part.alias("part"), (many > 1).alias("split"), "weight", "node", "data"), parts, patient, prepare))
        more, left = found.where(F.col("kind") == LINK).select("a", "b"), found.where(F.col("kind") == REST).select("key", F.col("a").alias("node"))
        links, rest = (more, left) if links is None else (links.unionByName(more), rest.unionByName(left))
        leaders = found.where(F.col("kind") == LEADER)
        n = leaders.count()
        if n == 0 or n == before:
            return links, rest
        before = n
        sizes = leaders.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        members = leaders.join(sizes, "key").select(F.col("key").alias("home"), "key", F.col("a").alias("node"), "size", F.lit(0).cast("long").alias("weight"), "data")


def settled(size: Column) -> Column:
    """Whether a bucket of this size is small enough for whoever its first member leaves out to meet all others."""
    return (size * (size - 1) <= FEW) & (size <= GROUP)


def weighed(shared: DataFrame, least: int) -> DataFrame:
    """``shared`` (key, home, node, size) with ``weight``: the sizes of all buckets of at least ``least`` members that a node is in."""
    heavy = shared.where(F.col("size") >= least).groupBy("node").agg(F.sum("size").alias("weight"))
    weight: Column = F.coalesce("weight", F.lit(0))
    return shared.join(heavy, "node", "left").select("key", "home", "node", "size", weight.cast("long").alias("weight"))
