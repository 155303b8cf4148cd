"""From words and turns to speaker-labelled entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import last_known, stab

BIN_US = 4_000_000
CHUNK_US = 60_000_000
MAX_GAP_US = 1_500_000


def cover(words: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn that covers each word's middle: the one with most of the word; ties go to the earliest start. ``provisional`` if several cover it."""
    t = turns.select("channel", "speaker", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"), F.col("seq").alias("t_seq"))
    found = stab(words, t, ["channel"], "mid_us", "t_start", "t_end", BIN_US)
    shared = F.least("t_end", "end_us") - F.greatest("t_start", "start_us")
    best = found.groupBy(*words.columns).agg(F.min_by("speaker", F.struct(-shared, "t_start", "t_seq")).alias("speaker"), F.count(F.lit(1)).alias("n_cover"))
    return best.withColumn("provisional", F.col("n_cover") > 1)


def nearest(words: DataFrame, turns: DataFrame) -> DataFrame:
    """The turn nearest to each word's middle for words that no turn covers; a tie goes to the turn before; ``S0`` without turns."""
    mark = lambda df, t, side, seq, who: df.select("channel", F.col(t).alias("t"), F.lit(side).alias("side"), F.col(seq).alias("seq"), who)
    ends = turns.withColumn("before", F.struct(F.col("end_us").alias("t"), (-F.col("start_us")).alias("s"), (-F.col("seq")).alias("q"), "speaker"))
    points = mark(words, "mid_us", 1, "seq", F.lit(None).cast(ends.schema["before"].dataType).alias("before"))
    rows = points.unionByName(mark(ends, "end_us", 0, "seq", "before"))
    behind = last_known(rows.withColumn("s", F.col("before.s")).withColumn("q", F.col("before.q")), ["channel"], ["t", "side", "s", "q", "seq"], "t", "before", CHUNK_US, "found_before").where("side = 1")
    starts = turns.select("channel", "speaker", F.col("seq").alias("t_seq"), (-F.col("start_us")).alias("t")).withColumn("after", F.struct((-F.col("t")).alias("t"), "speaker"))
    points = words.select("channel", (-F.col("mid_us")).alias("t"), F.lit(1).alias("side"), "seq", F.lit(None).cast(starts.schema["after"].dataType).alias("after"))
    rows = points.unionByName(starts.select("channel", "t", F.lit(0).alias("side"), (-F.col("t_seq")).alias("seq"), "after"))
    ahead = last_known(rows, ["channel"], ["t", "side", "seq"], "t", "after", CHUNK_US, "found_after").where("side = 1")
    both = words.join(behind.select("channel", "seq", "found_before"), ["channel", "seq"]).join(ahead.select("channel", "seq", "found_after"), ["channel", "seq"])
    left, right = F.col("mid_us") - F.col("found_before.t"), F.col("found_after.t") - F.col("mid_us")
    speaker = F.when(left.isNotNull() & (right.isNull() | (left <= right)), F.col("found_before.speaker")).otherwise(F.coalesce("found_after.speaker", F.lit("S0")))
    return both.select(*words.columns, speaker.alias("speaker"))


def assign(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Every word with a speaker: by cover, else by nearness."""
    covered = cover(words, turns)
    rest = words.join(covered.select("channel", "seq"), ["channel", "seq"], "left_anti").select(*words.columns)
    near = nearest(rest, turns).withColumn("n_cover", F.lit(0).cast("long")).withColumn("provisional", F.lit(False))
    return covered.unionByName(near)


def sessions(words: DataFrame, key: Sequence[str] = ("channel",), speaker: str | None = "speaker", max_gap: int = MAX_GAP_US) -> DataFrame:
    """``run``: closes where the speaker changes or the next word starts over ``max_gap`` after the last word's end."""
    order = W.partitionBy(*key).orderBy("start_us", "seq")
    opens = F.lag("end_us").over(order).isNull() | (F.col("start_us") - F.lag("end_us").over(order) > max_gap)
    if speaker:
        opens = opens | (F.lag(speaker).over(order) != F.col(speaker))
    return words.withColumn("_open", opens.cast("int")).withColumn("run", F.sum("_open").over(order)).drop("_open")


def to_entries(runs: DataFrame, key: Sequence[str] = ("channel",)) -> DataFrame:
    """A row per run: speaker, text in order, first start, last end, and whether any word was provisional."""
    ordered = F.array_sort(F.collect_list(F.struct("start_us", "seq", "end_us", "text")))
    made = runs.groupBy(*key, "run", "speaker").agg(ordered.alias("ws"), F.bool_or("provisional").alias("provisional"))
    return made.select(
        *key, "run", "speaker", F.array_join("ws.text", " ").alias("text"), F.col("ws")[0]["start_us"].alias("start_us"),
        F.element_at("ws", -1)["end_us"].alias("end_us"), "provisional", F.size("ws").cast("long").alias("n_words"),
    )


def first_appearance(rows: DataFrame, label: str, order: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``: labels numbered from 1 by where they first appear."""
    first = F.min(F.struct(*order)).over(W.partitionBy(*key, label))
    return rows.withColumn("_first", first).withColumn("rank", F.dense_rank().over(W.partitionBy(*key).orderBy("_first")).cast("long")).drop("_first")
