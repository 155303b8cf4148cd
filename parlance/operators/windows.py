"""Budgeted windows, cues and chunks: runs whose end depends on where they began.

A run always ends at certain breaks (a long silence, a new entry), so rows are first parted there
with window functions; only the short stretches between breaks are folded in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_WINDOW_US, MAX_GAP_US, PAD_US = 30_000_000, 5_000_000, 150_000
CUE_CHARS, CUE_US, CUE_GAP_US = 84, 6_000_000, 1_000_000


def add_segment(open_windows: list[list[int]], start: int, end: int, longest: int = MAX_WINDOW_US, gap: int = MAX_GAP_US) -> None:
    """One more speech segment: it joins the last window if that stays within the budget, or starts its own; an oversized one is cut."""
    if end - start > longest:
        open_windows.extend([t, min(t + longest, end)] for t in range(start, end, longest))
    elif open_windows and end - open_windows[-1][0] <= longest and start - open_windows[-1][1] <= gap:
        open_windows[-1][1] = end
    else:
        open_windows.append([start, end])


def fold_groups(rows: DataFrame, key: list[str], order: list[str], fold: Callable[[list[tuple]], list[tuple]], ddl: str) -> DataFrame:
    """``fold`` of the rows of each key in order, as tuples, which gives the rows to return.

    Rows are dealt by key and sorted, and a task walks through its share once, so that small groups
    cost no call of their own; it holds one group and one batch at a time.
    """
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        width = len(key)
        for pdf in batches:
            out: list[tuple] = []
            for row in zip(*[pdf[c].tolist() for c in pdf.columns]):
                if held and held[-1][:width] != row[:width]:
                    out += fold(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fold(held), columns=names)

    rest = [c for c in rows.columns if c not in key]
    return rows.select(*key, *rest).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, ddl)


def packed(segments: DataFrame, longest: int = MAX_WINDOW_US, gap: int = MAX_GAP_US) -> DataFrame:
    """(channel, number, start_us, end_us) of decode windows over disjoint segments (channel, start_us, end_us), without padding."""

    def fold(rows: list[tuple]) -> list[tuple]:
        made: list[list[int]] = []
        for _, start, end in rows:
            add_segment(made, start, end, longest, gap)
        return [(rows[0][0], k, *w) for k, w in enumerate(made)]

    return fold_groups(segments.select("channel", "start_us", "end_us"), ["channel"], ["start_us", "end_us"], fold, "channel long, number long, start_us long, end_us long")


def pack_windows(segments: DataFrame, total_us: Column, longest: int = MAX_WINDOW_US, gap: int = MAX_GAP_US, pad: int = PAD_US) -> DataFrame:
    """(channel, start_us, end_us) of decode windows over disjoint segments (channel, start_us, end_us), padded but still disjoint."""
    order = W.partitionBy("channel").orderBy("start_us", "end_us")
    limits = segments.groupBy("channel").agg(total_us.alias("_total"))
    padded = packed(segments, longest, gap).join(limits, "channel").withColumn("_end", F.least("_total", F.col("end_us") + pad))
    before = F.coalesce(F.lag("_end").over(order), F.lit(0))
    return padded.select("channel", F.greatest(F.lit(0), F.col("start_us") - pad, before).alias("start_us"), F.col("_end").alias("end_us"))


def cues(entries: DataFrame, key: list[str]) -> DataFrame:
    """Cues of entries with ``speaker`` and ``ws`` (words with start_us, end_us, text in order): a cue ends before 84 characters, 6 s or a 1 s pause are passed."""

    @F.arrow_udf("array<struct<start_us: bigint, end_us: bigint, text: string>>")
    def all_cues(ws: pa.Array) -> pa.Array:
        # Words stay in Arrow; a cue is known by its first word.
        many = pc.fill_null(pc.list_value_length(ws), 0).to_numpy(zero_copy_only=False)
        words = ws.flatten()
        start, end, size = words.field("start_us").to_pylist(), words.field("end_us").to_pylist(), pc.utf8_length(words.field("text")).to_pylist()
        firsts, ends, at = [], [0], 0
        for n in many.tolist():
            for i in range(at, at + n):
                if i > at and chars + 1 + size[i] <= CUE_CHARS and end[i] - start[firsts[-1]] <= CUE_US and start[i] - end[i - 1] <= CUE_GAP_US:
                    chars += 1 + size[i]
                else:
                    firsts.append(i)
                    chars = size[i]
            at += n
            ends.append(len(firsts))
        bounds = np.array([*firsts, at], dtype=np.int32)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words.field("text")), " ")
        made = [words.field("start_us").take(pa.array(bounds[:-1])), words.field("end_us").take(pa.array(bounds[1:] - 1)), text]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, names=["start_us", "end_us", "text"]))

    made = entries.select(*key, "speaker", F.posexplode(all_cues("ws")).alias("seq", "c"))
    return made.select(*key, "speaker", "seq", "c.start_us", "c.end_us", "c.text")


def chunks(lines: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, chunk, text): whole lines (key, seq, text) joined by line feeds up to a budget of characters; a longer line stands alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made: list[str] = []
        for line in pdf.sort_values("seq")["text"]:
            if made and len(made[-1]) + 1 + len(line) <= budget:
                made[-1] += "\n" + line
            else:
                made.append(line)
        return pd.DataFrame({key: pdf[key].iloc[0], "chunk": range(len(made)), "text": made})

    return lines.select(key, "seq", "text").groupBy(key).applyInPandas(run, f"{key} long, chunk int, text string")


def islands(rows: DataFrame, key: list[str], order: str, flag: str) -> DataFrame:
    """Half-open runs (start, end) of consecutive places where ``flag`` holds."""
    kept = rows.where(flag)
    n = F.row_number().over(W.partitionBy(*key).orderBy(order))
    return kept.withColumn("_i", F.col(order) - n).groupBy(*key, "_i").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("_i")


def padded_turns(turns: DataFrame, pad_us: int) -> DataFrame:
    """Disjoint turns widened by ``pad_us``, to the middle of the pause at most when neighbours are near."""
    order = W.partitionBy("channel").orderBy("start_us", "end_us")
    before, after = F.lag("end_us").over(order), F.lead("start_us").over(order)
    low = F.greatest(F.col("start_us") - pad_us, F.coalesce(F.least(before, F.col("start_us")), F.lit(0)))
    high = F.least(F.col("end_us") + pad_us, F.coalesce(F.greatest(after, F.col("end_us")), F.col("end_us") + pad_us))
    return turns.select("channel", low.alias("start_us"), high.alias("end_us"))
