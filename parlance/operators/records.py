"""Smaller operators on samples, segments, profiles and judgements."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusters import clustered_by

SAMPLE_RATE, KEPT_VECTORS = 16_000, 8


def downmix(frames: DataFrame) -> DataFrame:
    """Mono samples of (stream, frame, channel, sample): the mean over channels, cut towards zero."""
    return frames.groupBy("stream", "frame").agg((F.sum("sample") / F.count("sample")).cast("int").alias("sample"))


def deinterleave(blocks: DataFrame, channels: int) -> DataFrame:
    """(stream, channel, place, sample) of interleaved arrays (stream, samples)."""
    rows = blocks.select("stream", F.posexplode("samples").alias("i", "sample"))
    return rows.select("stream", (F.col("i") % channels).alias("channel"), F.floor(F.col("i") / channels).alias("place"), "sample")


def mix(frames: DataFrame) -> DataFrame:
    """The sum over channels per stream and place, scaled down where a stream would pass 32767."""
    sums = frames.groupBy("stream", "place").agg(F.sum("sample").alias("sample"))
    top = sums.groupBy("stream").agg(F.max(F.abs("sample")).alias("top"))
    scale = F.when(F.col("top") > 32767, 32767.0 / F.col("top")).otherwise(1.0)
    return sums.join(top, "stream").select("stream", "place", (F.col("sample") * scale).cast("int").alias("sample"))


def to_float(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / 32768.0)


def to_int16(samples: Column) -> Column:
    """Scaled, rounded half to even, and clipped."""
    return F.transform(samples, lambda x: F.least(F.greatest(F.bround(x * 32768.0), F.lit(-32768.0)), F.lit(32767.0)).cast("short"))


def sample_index(seconds: Column) -> Column:
    """The sample at or before a time: cut, never rounded."""
    return (seconds * SAMPLE_RATE).cast("long")


def paired_frames(far: DataFrame, near: DataFrame) -> DataFrame:
    """Near frames (stream, tick, near) with the far frame of the same tick; silence where there is none."""
    return near.join(far, ["stream", "tick"], "left").select("stream", "tick", "near", F.coalesce("far", F.lit(0)).alias("far"))


def shifted(segments: DataFrame, offset: Column) -> DataFrame:
    """Segments (start, end, words) moved in time with their words."""
    moved = F.transform("words", lambda w: w.withField("start", w["start"] + offset).withField("end", w["end"] + offset))
    return segments.withColumn("words", moved).withColumn("start", F.col("start") + offset).withColumn("end", F.col("end") + offset)


def clipped(segments: DataFrame, keep_from: Column) -> DataFrame:
    """Segments with the words whose middle is at or after a bound; one that loses none passes unchanged, one that loses all goes."""
    kept = F.filter("words", lambda w: (w["start"] + w["end"]) / 2 >= keep_from)
    whole = F.size(kept) == F.size("words")
    text = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda w: w["text"]), " "))
    start, end = (F.when(whole, F.col(c)).otherwise(x[c]) for c, x in (("start", F.get(kept, F.lit(0))), ("end", F.try_element_at(kept, F.lit(-1)))))
    return segments.where(F.size(kept) > 0).select(*[c for c in segments.columns if c not in ("text", "start", "end", "words")], text.alias("text"), start.alias("start"), end.alias("end"), kept.alias("words"))


def merged_tokens(tokens: DataFrame) -> DataFrame:
    """Words of (key, seq, text, start_us, end_us, confidence): a token with a leading space opens a word, as does one after a lone space; the weakest confidence counts."""
    order = W.partitionBy("key").orderBy("seq")
    lone = F.trim("text") == ""
    before = F.lag("text").over(order)
    opens = before.isNull() | F.startswith("text", F.lit(" ")) | (F.trim(before) == "")
    runs = tokens.withColumn("_open", (opens & ~lone).cast("int")).withColumn("word", F.sum("_open").over(order)).where(F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("text"))))
    return runs.groupBy("key", "word").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min("confidence").alias("confidence")
    )


def sentences(words: DataFrame) -> DataFrame:
    """(key, sentence, text): a sentence ends with a word that ends in . ! ? or an ellipsis."""
    order = W.partitionBy("key").orderBy("seq")
    ended = F.coalesce(F.lag("text").over(order).rlike("[.!?…]$"), F.lit(False)).cast("int")
    numbered = words.withColumn("_e", ended).withColumn("sentence", F.sum("_e").over(order))
    return numbered.groupBy("key", "sentence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))


def caption_lines(words: DataFrame, most_chars: int = 250, gap_us: int = 1_500_000) -> DataFrame:
    """Caption lines of one channel's words: a pause over ``gap_us`` ends a line, as does reaching ``most_chars``. Parted at pauses first, then counted in order."""
    order = W.partitionBy("channel").orderBy("start_us", "seq")
    opens = F.coalesce(F.col("start_us") - F.lag("end_us").over(order) > gap_us, F.lit(True)).cast("int")
    parted = words.withColumn("_o", opens).withColumn("part", F.sum("_o").over(order))

    @F.pandas_udf("array<int>")
    def numbered(sizes: pd.Series) -> pd.Series:
        out = []
        for row in sizes:
            line, chars, numbers = 0, 0, []
            for n in row.tolist():
                numbers.append(line)
                chars += n + (chars > 0)
                if chars >= most_chars:
                    line, chars = line + 1, 0
            out.append(numbers)
        return pd.Series(out)

    # A part is a row, as most have a few words and a call for each would cost more than they do.
    made = parted.groupBy("channel", "part").agg(F.array_sort(F.collect_list(F.struct("start_us", "seq", F.char_length("text").alias("n")))).alias("w"))
    rows = made.select("channel", "part", F.explode(F.arrays_zip(F.col("w.seq").alias("seq"), numbered("w.n").alias("line"))).alias("x"))
    return rows.select("channel", "part", "x.seq", "x.line")


def upserted(store: DataFrame, new: DataFrame, most: int = KEPT_VECTORS) -> DataFrame:
    """Profile vectors (name, model, idx, vector, date) with new ones added; of each (name, model) the newest ``most`` stay, undated ones going first."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = W.partitionBy("name", "model").orderBy(F.col("date").desc_nulls_last(), F.desc("_new"), F.desc("idx"))
    kept = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    return kept.withColumn("idx", F.row_number().over(W.partitionBy("name", "model").orderBy("_new", "idx")).cast("long")).drop("_new", "_n")


def renamed(store: DataFrame, old: str, new: str) -> DataFrame:
    """The store with a profile renamed; vectors of both names are one profile then."""
    return upserted(store.where(F.col("name") != old), store.where(F.col("name") == old).withColumn("name", F.lit(new)))


def removed(store: DataFrame, name: str) -> DataFrame:
    """The store without a profile."""
    return store.where(F.col("name") != name)


def assigned(entries: DataFrame, label: str, name: str) -> DataFrame:
    """Entries with a label replaced by a name."""
    return entries.withColumn("speaker", F.when(F.col("speaker") == label, name).otherwise(F.col("speaker")))


def wins(picks: DataFrame) -> DataFrame:
    """Per model, language and bucket of (models array, pick, language, bucket): sites it was in, and those where its variant was picked; null and negative picks are skipped."""
    rows = picks.where("pick is not null and pick >= 0").select("language", "bucket", "pick", F.posexplode("models").alias("variant", "names"))
    each = rows.select("language", "bucket", F.explode("names").alias("model"), (F.col("variant") == F.col("pick")).alias("won"))
    return each.groupBy("model", "language", "bucket").agg(F.count(F.lit(1)).alias("sites"), F.count_if("won").alias("wins"))


def round_robin(rows: DataFrame, bucket: str, order: list[str], most: int) -> DataFrame:
    n = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("_n", n).orderBy("_n", bucket).limit(most).drop("_n")


def clustered(points: DataFrame, threshold: float) -> DataFrame:
    """Average-link clusters of each key's few unit vectors (key, seq, v), merged while the mean cosine is at least the threshold, numbered by first appearance."""
    return clustered_by(points, "average", threshold=math.nextafter(1.0 - threshold, 3.0))


def best_lag(frames: DataFrame, span: int) -> DataFrame:
    """Per stream of (stream, tick, near, far) the lag within ``span`` ticks with the greatest normalised product; the least lag on ties."""
    far = frames.select("stream", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("lag"), "tick", "far").select("stream", "lag", (F.col("tick") + F.col("lag")).alias("tick"), "far")
    both = frames.select("stream", "tick", "near").join(far, ["stream", "tick"])
    norm = F.sqrt(F.sum(F.col("near") * F.col("near")) * F.sum(F.col("far") * F.col("far")))
    score = both.groupBy("stream", "lag").agg(F.coalesce(F.sum(F.col("near") * F.col("far")) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).alias("score"))
    return score.groupBy("stream").agg(F.expr("min_by(lag, struct(-round(score, 9), lag))").alias("lag"), F.round(F.max("score"), 6).alias("score"))


def hysteresis(values: list[float], high: float, low: float) -> list[bool]:
    """Places at or above ``high``, grown over neighbours at or above ``low``."""
    on = [v >= high for v in values]
    for order in (range(1, len(values)), range(len(values) - 2, -1, -1)):
        for i in order:
            before = i - 1 if order.step > 0 else i + 1
            on[i] = on[i] or (on[before] and values[i] >= low)
    return on


def token_scores(depth: int, first: float = 1.0, factor: float = 2.0) -> float:
    return first if depth <= 1 else first * factor + math.log(depth)


def quiet_cuts(levels: list[float], every: int, reach: int) -> list[int]:
    """Places to cut at: near each multiple of ``every`` after the last cut, the quietest within ``reach`` on either side; the first of equals."""
    cuts, at = [], 0
    while at + every < len(levels):
        low, high = max(at + 1, at + every - reach), min(len(levels) - 1, at + every + reach)
        at = min(range(low, high + 1), key=lambda i: (levels[i], i))
        cuts.append(at)
    return cuts
