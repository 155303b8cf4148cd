"""Words and turns as streams, keyed by channel: watermarks, append-only words, online windows, checkpoints."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import PAD_US, add_segment
from ..sources.derived import SCALE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BACKWARD_US, SHED_US, DEAD_TICKS = 10_000, 30_000_000, 30


def stream_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """(seq, channel, start_us, end_us, label, ts) of the events in a folder's files, one file a trigger."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)
    start = F.expr(f"(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) div {SCALE}")
    length = F.floor(F.least(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.1)), F.lit(30.0)) * 100000).cast("long")
    return raw.select(F.col("event_id").alias("seq"), F.col("user_id").alias("channel"), start.alias("start_us"), (start + length).alias("end_us"), F.col("event_type").alias("label"), F.col("ts").cast("timestamp").alias("ts"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="streams-")


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that a finite stream gives: every micro-batch is written as a Parquet folder of its own, which a batch that is run again replaces. In complete mode the last one counts."""
    folder = f"{shared_folder(stream.sparkSession)}/{name}"
    done: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")
        done.append(n)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    if not batches:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(*[f"{folder}/batch={n}" for n in batches])


def watermarks(stream: DataFrame) -> DataFrame:
    """The latest end per channel so far."""
    return stream.groupBy("channel").agg(F.max("end_us").alias("watermark_us"), F.count(F.lit(1)).alias("n"))


def sliding_counts(stream: DataFrame, late: str = "10 minutes", size: str = "10 hours", step: str = "1 hour") -> DataFrame:
    """Records in sliding event-time windows; those later than the watermark are dropped by Spark, unlike ``append_only``, which can fail on them."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, step), "label").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "label", "n")


def append_only(stream: DataFrame, strict: bool = False) -> DataFrame:
    """Records whose start is not before an earlier one of their channel; ``strict`` fails on a step back of over 10 ms instead."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        kept = []
        for start in rows["start_us"]:
            if strict and latest is not None and start < latest - BACKWARD_US:
                raise ValueError(f"channel {key[0]} steps back from {latest} to {start}")
            kept.append(latest is None or start + 1 >= latest)
            latest = start if latest is None else max(latest, start)
        state.update((int(latest),))
        yield rows.loc[kept, ["seq", "channel", "start_us"]]

    keyed = stream.select("channel", "seq", "start_us").groupBy("channel")
    return keyed.applyInPandasWithState(run, "seq long, channel long, start_us long", "latest long", "append", GroupStateTimeout.NoTimeout)


def online_windows(stream: DataFrame) -> DataFrame:
    """Decode windows while turns arrive in order of start: (channel, number, start_us, end_us), sent again whenever they grow.

    Only the last window and the segment that may still grow are kept as state. What was sent last
    for a number equals the batch result before padding, see ``settled``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, Any] = json.loads(state.get[0]) if state.exists else {"done": 0, "windows": [], "segment": None}
        windows, segment, done = held["windows"], held["segment"], held["done"]
        for s, e in pd.concat(list(batches)).sort_values(["start_us", "end_us"])[["start_us", "end_us"]].itertuples(index=False):
            if segment and s <= segment[1]:
                segment[1] = max(segment[1], int(e))
            else:
                if segment:
                    add_segment(windows, *segment)
                segment = [int(s), int(e)]
        shown = [list(w) for w in windows]
        add_segment(shown, *segment)
        sent = pd.DataFrame({"channel": key[0], "number": range(done, done + len(shown)), "start_us": [w[0] for w in shown], "end_us": [w[1] for w in shown]})
        keep = windows[-1:]
        state.update((json.dumps({"done": done + len(windows) - len(keep), "windows": keep, "segment": segment}),))
        yield sent

    keyed = stream.select("channel", "start_us", "end_us").groupBy("channel")
    return keyed.applyInPandasWithState(run, "channel long, number long, start_us long, end_us long", "held string", "update", GroupStateTimeout.NoTimeout)


def settled(sent: DataFrame, limits: DataFrame) -> DataFrame:
    """The last state of each window, padded: equal to the batch result. ``limits`` is (channel, total_us)."""
    last = sent.groupBy("channel", "number").agg(F.max("end_us").alias("end_us"), F.min("start_us").alias("start_us")).join(limits, "channel")
    padded = last.withColumn("_end", F.least("total_us", F.col("end_us") + PAD_US))
    before = F.coalesce(F.lag("_end").over(W.partitionBy("channel").orderBy("start_us")), F.lit(0))
    return padded.select("channel", F.greatest(F.lit(0), F.col("start_us") - PAD_US, before).alias("start_us"), F.col("_end").alias("end_us"))


def checkpoint_to(stream: DataFrame, folder: str, make: Callable[[DataFrame], DataFrame]):
    """A running query that writes ``make`` of each micro-batch under ``folder``; a batch that is run again replaces its own files."""
    return stream.writeStream.foreachBatch(lambda df, n: make(df).write.mode("overwrite").json(f"{folder}/batch={n}")).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()


def shed(windows: DataFrame, cap_us: int = SHED_US) -> tuple[DataFrame, DataFrame]:
    """Windows (channel, start_us, end_us, now_us) that are not over ``cap_us`` behind, and the time shed per channel."""
    late = F.col("now_us") - F.col("end_us") > cap_us
    return windows.where(~late), windows.where(late).groupBy("channel").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("shed_us"), F.count(F.lit(1)).alias("n"))


def dead_taps(ticks: DataFrame, least: int = DEAD_TICKS) -> DataFrame:
    """Stretches of at least ``least`` ticks (channel, tick, far, mic) where the far side is silent while the mic is live; ticks with a silent mic do not end one."""
    live = ticks.where("mic > 0 or far > 0")
    runs = live.withColumn("_run", F.sum((F.col("far") > 0).cast("int")).over(W.partitionBy("channel").orderBy("tick")))
    silent = runs.where("far = 0").groupBy("channel", "_run").agg(F.min("tick").alias("start"), F.max("tick").alias("end"), F.count(F.lit(1)).alias("n"))
    return silent.where(F.col("n") >= least).drop("_run")
