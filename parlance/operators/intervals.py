"""Joins and set algebra on half-open intervals.

Unequal join conditions alone would compare all rows with all rows, so intervals are spread over
the bins of a fixed width that they touch and joined on key and bin; a pair that meets in several
bins is reported once, in the bin where the later of the two starts. Bins also spread a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bin_of(t: Column, width: int) -> Column:
    return F.floor(t / width).cast("long")


def spread(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row per bin that [start, end) touches, as ``_bin``; an empty interval touches the bin of its start."""
    last = F.greatest(bin_of(F.col(start), width), bin_of(F.col(end) - 1, width))
    return df.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start), width), last)))


def stab(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the intervals where start <= at < end. Names must differ but for the key."""
    binned = points.withColumn("_bin", bin_of(F.col(at), width))
    other = spread(intervals, start, end, width)
    for k in [*key, "_bin"]:
        other = other.withColumnRenamed(k, f"_r_{k}")
    same = [binned[k] == other[f"_r_{k}"] for k in [*key, "_bin"]]
    condition = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    for c in same:
        condition = condition & c
    return binned.join(other, condition, how).drop("_bin", *[f"_r_{k}" for k in [*key, "_bin"]])


def overlap(left: DataFrame, right: DataFrame, key: Sequence[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs of intervals of a key that share more than a point, with ``shared``."""
    x, y = spread(left, *a, width), spread(right, *b, width)
    joined = x.join(y, [*key, "_bin"])
    low, high = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return joined.where((low < high) & (bin_of(low, width) == F.col("_bin"))).withColumn("shared", high - low).drop("_bin")


def last_known(df: DataFrame, key: Sequence[str], order: Sequence[str], t: str, value: str, width: int, name: str) -> DataFrame:
    """The latest non-null ``value`` at or before each row, in two levels: within a stretch of time, and from the stretches before."""
    rows = df.withColumn("_chunk", bin_of(F.col(t), width))
    inner = W.partitionBy(*key, "_chunk").orderBy(*order)
    here = rows.withColumn("_here", F.last(value, ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, W.currentRow)))
    tops = rows.where(F.col(value).isNotNull()).groupBy(*key, "_chunk").agg(F.max_by(value, F.struct(*order)).alias("_top"))
    places = rows.select(*key, "_chunk").distinct().join(tops, [*key, "_chunk"], "left")
    before = W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = places.withColumn("_carried", F.last("_top", ignorenulls=True).over(before)).select(*key, "_chunk", "_carried")
    return here.join(carried, [*key, "_chunk"]).withColumn(name, F.coalesce("_here", "_carried")).drop("_chunk", "_here", "_carried")


def merge_gaps(df: DataFrame, key: Sequence[str], start: str, end: str, gap: int) -> DataFrame:
    """Intervals of a key united where the next starts at most ``gap`` after the latest end so far."""
    order = W.partitionBy(*key).orderBy(start, end)
    latest = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = df.withColumn("_open", F.when(latest.isNull() | (F.col(start) - latest > gap), 1).otherwise(0))
    runs = opens.withColumn("_run", F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy(*key, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def depth(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """The stretches between neighbouring bounds of a key's intervals, with the number of intervals over each."""
    edges = df.select(*key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*key, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    order = W.partitionBy(*key).orderBy("t")
    rows = steps.select(*key, F.col("t").alias("start_us"), F.lead("t").over(order).alias("end_us"), F.sum("d").over(order).alias("depth"))
    return rows.where("end_us is not null")


def subtract(spans: DataFrame, cuts: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """What is left of the spans outside all cuts, as disjoint stretches."""
    tag = lambda df, w: df.select(*key, start, end).withColumn("w", F.lit(w))
    both = tag(spans, 1).unionByName(tag(cuts, 1 << 20))
    edges = both.select(*key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.col("w").alias("d")), F.struct(F.col(end).alias("t"), (-F.col("w")).alias("d")))).alias("e"))
    steps = edges.groupBy(*key, F.col("e.t").alias("t")).agg(F.sum("e.d").cast("long").alias("d"))
    order = W.partitionBy(*key).orderBy("t")
    rows = steps.select(*key, F.col("t").alias(start), F.lead("t").over(order).alias(end), F.sum("d").over(order).alias("w"))
    return merge_gaps(rows.where(f"{end} is not null and w > 0 and w < {1 << 20}").drop("w"), key, start, end, 0)
