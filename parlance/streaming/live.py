"""Live state per channel: captions that close by themselves, runs sent once, bounded buffers, windows decoded once.

All of these keep a few numbers and the records of what is still open as state, however long a channel runs.
What is open when a finite stream ends is read back from the state store (``still_open``), so that
the stream itself only ever sends finished rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from ..operators.speech import MAX_GAP_US
from ..operators.windows import PAD_US, add_segment

IDLE_MS, LINE_CHARS, LINE_GAP_US = 5_000, 250, 1_500_000
#: What a late window may still need before its start.
CONTEXT_US = 15_000_000
CAPTIONS = "channel long, line long, side string, start_us long, end_us long, text string"
RUNS = "channel long, run long, start_us long, end_us long, n_words long, text string"
VIEWS = "channel long, number long, start_us long, end_us long, from_us long, n long, total double, held long"


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> list[dict]:
    """The rows of a group in this micro-batch, in order."""
    found = [b for b in batches if len(b)]
    return pd.concat(found).sort_values(list(order)).to_dict("records") if found else []


def _held(state: GroupState, fresh: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else fresh


def _named(key: tuple, ddl: str, rows: list[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in ddl.split(", ")]
    return pd.DataFrame([{"channel": key[0], **r} for r in rows], columns=names)


def live_captions(words: DataFrame, idle_ms: int | None = IDLE_MS, most_chars: int = LINE_CHARS, gap_us: int = LINE_GAP_US) -> DataFrame:
    """Caption lines of (channel, seq, side, text, start_us, end_us), each sent once when it is finished.

    A word continues the open line if it comes from the same side, at most ``gap_us`` after the
    line's end; it finishes the line if that then has ``most_chars`` characters. A line that no word
    has reached for ``idle_ms`` of processing time is finished by a timer, without any further word (null: no timer, for streams that are read at once).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, sent = _held(state, {"line": 0, "open": None}), []

        def finish() -> None:
            if held["open"]:
                sent.append({"line": held["line"], **held["open"]})
                held["line"], held["open"] = held["line"] + 1, None

        if state.hasTimedOut:
            finish()
        for w in _rows(batches, "seq"):
            line = held["open"]
            if line and line["side"] == w["side"] and w["start_us"] - line["end_us"] <= gap_us:
                line["text"], line["end_us"] = f"{line['text']} {w['text']}", w["end_us"]
            else:
                finish()
                held["open"] = {k: w[k] for k in ("side", "start_us", "end_us", "text")}
            if len(held["open"]["text"]) >= most_chars:
                finish()
        state.update((json.dumps(held),))
        if held["open"] and idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield _named(key, CAPTIONS, sent)

    keyed = words.select("channel", "seq", "side", "text", "start_us", "end_us").groupBy("channel")
    return keyed.applyInPandasWithState(run, CAPTIONS, "held string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def closed_runs(words: DataFrame, max_gap: int = MAX_GAP_US) -> DataFrame:
    """Runs of the words (channel, seq, text, start_us, end_us) of a channel, each sent once, when a later word has shown that it is over.

    Only the newest run can still grow, so only its words are regrouped: state and work follow the
    new words, not the channel's length.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, sent = _held(state, {"run": 0, "open": None}), []
        for w in _rows(batches, "start_us", "seq"):
            last = held["open"]
            if last and w["start_us"] - last["end_us"] <= max_gap:
                last.update(end_us=w["end_us"], n_words=last["n_words"] + 1, text=f"{last['text']} {w['text']}")
                continue
            if last:
                sent.append({"run": held["run"], **last})
            held = {"run": held["run"] + 1, "open": {"start_us": w["start_us"], "end_us": w["end_us"], "n_words": 1, "text": w["text"]}}
        state.update((json.dumps(held),))
        yield _named(key, RUNS, sent)

    keyed = words.select("channel", "seq", "text", "start_us", "end_us").groupBy("channel")
    return keyed.applyInPandasWithState(run, RUNS, "held string", "append", GroupStateTimeout.NoTimeout)


def bounded_views(records: DataFrame, context_us: int = CONTEXT_US, pad_us: int = PAD_US) -> DataFrame:
    """For each decode window of a channel what is in its view: from ``context_us`` before its start to its end.

    ``records`` are (channel, seq, speech, start_us, end_us, value) in order of time: speech segments,
    which make the windows, and frames, which are kept until no open or coming window can need them, that is
    from ``context_us`` and ``pad_us`` before the open window, or before the newest record if there is none.
    The view is clamped to what is kept, from ``from_us`` on. ``held`` is the number of frames kept afterwards.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state, {"number": 0, "kept_from": 0, "windows": [], "segment": None, "frames": []})
        sent = []
        for r in _rows(batches, "start_us", "seq"):
            if not r["speech"]:
                held["frames"].append([r["start_us"], r["value"]])
                continue
            segment = held["segment"]
            if segment and r["start_us"] <= segment[1]:
                segment[1] = max(segment[1], r["end_us"])
                continue
            if segment:
                add_segment(held["windows"], *segment)
            held["segment"] = [r["start_us"], r["end_us"]]
            # The last window may still take the new segment in; those before it are over.
            after = [list(w) for w in held["windows"]]
            add_segment(after, *held["segment"])
            over = [w for w, now in zip(held["windows"], after) if w == now]
            for start, end in over:
                seen = [v for t, v in held["frames"] if max(start - context_us, held["kept_from"]) <= t < end]
                sent.append({"number": held["number"], "start_us": start, "end_us": end, "from_us": max(start - context_us, held["kept_from"]), "n": len(seen), "total": float(sum(seen))})
                held["number"] += 1
            held["windows"] = held["windows"][len(over) :]
            first = min([w[0] for w in held["windows"]] + [held["segment"][0]])
            held["kept_from"] = max(held["kept_from"], first - context_us - pad_us)
            held["frames"] = [f for f in held["frames"] if f[0] >= held["kept_from"]]
            for s in sent:
                s.setdefault("held", len(held["frames"]))
        if held["segment"] is None and held["frames"]:
            held["kept_from"] = max(held["kept_from"], held["frames"][-1][0] - context_us - pad_us)
            held["frames"] = [f for f in held["frames"] if f[0] >= held["kept_from"]]
        state.update((json.dumps(held),))
        yield _named(key, VIEWS, sent)

    keyed = records.select("channel", "seq", "speech", "start_us", "end_us", "value").groupBy("channel")
    return keyed.applyInPandasWithState(run, VIEWS, "held string", "append", GroupStateTimeout.NoTimeout)


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(channel, held): what each channel had open when the stream of this checkpoint ended, read from its state store."""
    try:
        return spark.read.format("statestore").load(checkpoint).select(F.col("key.channel").alias("channel"), F.col("value.groupState.held").alias("held"))
    except AnalysisException:  # a stream that never had a batch has no state
        return spark.createDataFrame([], "channel long, held string")


def open_rows(spark: SparkSession, checkpoint: str, ddl: str, number: str) -> DataFrame:
    """The open captions or runs of a finished stream in the columns of ``ddl``; ``number`` is the one that counts them."""
    fields = ddl.split(", ")
    inner = ", ".join(c for c in fields if c.split()[0] not in ("channel", number))
    parsed = F.from_json("held", f"{number} long, open struct<{', '.join(c.replace(' ', ':', 1) for c in inner.split(', '))}>")
    rows = still_open(spark, checkpoint).withColumn("x", parsed).where("x.open is not null")
    named = {"channel": F.col("channel"), number: F.col(f"x.{number}")}
    return rows.select(*[named.get(c.split()[0], F.col(f"x.open.{c.split()[0]}")).alias(c.split()[0]) for c in fields])


def committed(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """The rows of all committed batches."""
    try:
        done = spark.read.parquet(f"{folder}-done").select(F.col("batch").cast("long")).distinct()
    except AnalysisException:
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(f"{ddl}, batch long").parquet(folder)
    return rows.join(done, "batch").drop("batch")


def decode_once(windows: DataFrame, folder: str, decode: Callable[[DataFrame], DataFrame] = lambda batch: batch, **trigger: object) -> StreamingQuery:
    """A running query that writes ``decode`` of every finished window exactly once, also when it is killed and started again on the same folder.

    Each micro-batch is a folder of its own, marked when it is whole. A batch that is run again after a failure
    replaces its folder, and readers (``committed``) take marked folders only.
    """

    def keep(batch: DataFrame, n: int) -> None:
        decode(batch).write.mode("overwrite").parquet(f"{folder}/batch={n}")
        batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{folder}-done/batch={n}")

    return windows.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{folder}-state").trigger(**(trigger or {"availableNow": True})).start()


def reused(live: DataFrame, again: DataFrame, shed: DataFrame, key: str = "channel") -> DataFrame:
    """The live rows of channels that shed nothing; for the others, and for channels without live rows, those of ``again``.

    ``shed`` is (channel, shed_us). ``again`` is only evaluated for the channels that need it.
    """
    late = shed.where("shed_us > 0").select(key).distinct()
    whole = live.join(late, key, "left_anti")
    return whole.unionByName(again.join(whole.select(key).distinct(), key, "left_anti"))


def seen_side(seq: Column) -> Column:
    """The side a word of the driver's events is said to come from."""
    return F.when(seq % 4 == 1, "mic").otherwise("system")
