"""Masks of dominant speech, quiet cuts, operating points, rates of biased words, and rules on devices, settings and labels."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import merge_gaps
from .matching import align
from .voices import best_match, highest_scores

#: Share of the loudest channel's level from which a channel counts as dominant; shares of its own level for seeds and for what grows from them; windows of growth, of hangover, and of gaps that are closed.
DOMINANT, STRONG, WEAK, GROWTH, HANGOVER, GAP = 0.5, 0.6, 0.2, 40, 2, 3


def dominant_spans(levels: DataFrame, key: str = "meeting", growth: int = GROWTH, hangover: int = HANGOVER, gap: int = GAP) -> DataFrame:
    """(key, channel, start, end): half-open spans of windows in which a channel of (key, channel, tick, level) is the one that speaks.

    A window is dominant if its level is ``DOMINANT`` of the loudest channel's or more. A channel's own level is
    the 90th percentile of the windows in which it is the loudest (of ties the first channel; the 95th of all with sound if there are none). Strong dominant windows are
    seeds, and weak ones stay within ``growth`` windows of a seed that a run of weak ones leads to. Spans are widened by ``hangover`` windows within the recording, and gaps of up to ``gap`` closed.
    """
    at = W.partitionBy(key, "tick")
    rows = levels.withColumn("_top", F.max("level").over(at)).withColumn("_first", F.min(F.struct(-F.col("level"), "channel")).over(at)["channel"])
    own = F.when((F.col("_first") == F.col("channel")) & (F.col("level") > 0), F.col("level"))
    usual = rows.groupBy(key, "channel").agg(F.expr("percentile(level, 0.95) filter (where level > 0)").alias("_any"), F.percentile(own, 0.9).alias("_own"), F.max("tick").alias("_last"))
    rows = rows.join(usual, [key, "channel"]).withColumn("_usual", F.coalesce("_own", "_any", F.lit(0.0)))
    dominant = (F.col("level") > 0) & (F.col("level") >= DOMINANT * F.col("_top"))
    weak = rows.where(dominant & (F.col("level") >= WEAK * F.col("_usual"))).withColumn("_strong", F.col("level") >= STRONG * F.col("_usual"))
    by = W.partitionBy(key, "channel").orderBy("tick")
    runs = weak.withColumn("_run", F.col("tick") - F.row_number().over(by))
    along = W.partitionBy(key, "channel", "_run").orderBy("tick")
    seed = F.when(F.col("_strong"), F.col("tick"))
    before = F.last(seed, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.first(seed, ignorenulls=True).over(along.rowsBetween(W.currentRow, W.unboundedFollowing))
    kept = runs.withColumn("_b", before).withColumn("_a", after).where((F.col("tick") - F.col("_b") <= growth) | (F.col("_a") - F.col("tick") <= growth))
    wide = kept.select(key, "channel", F.greatest(F.col("tick") - hangover, F.lit(0)).alias("start"), F.least(F.col("tick") + hangover, "_last").alias("end"))
    spans = merge_gaps(wide.select(key, "channel", "start", (F.col("end") + 1).alias("end")), [key, "channel"], "start", "end", gap)
    return spans.select(key, "channel", "start", "end")


def quiet_bounds(samples: np.ndarray, target: int, search: int, width: int) -> list[int]:
    """Bounds of pieces of about ``target`` samples: each cut is the middle of the quietest ``width`` samples, in steps of a third of that, within ``search`` of where the piece would end. What is left at one and a half targets or less is one piece."""
    total = np.concatenate([[0], np.cumsum(np.abs(samples.astype(np.int64)))])
    bounds = [0]
    while len(samples) - bounds[-1] > 1.5 * target:
        centre = bounds[-1] + target
        starts = np.arange(centre - search, centre + search - width, max(1, width // 3))
        starts = starts[(starts >= 0) & (starts + width <= len(samples))]
        bounds.append(int(starts[np.argmin(total[starts + width] - total[starts])]) + width // 2)
    return [*bounds, len(samples)]


def quiet_pieces(samples: DataFrame, target: int, search: int, width: int) -> DataFrame:
    """(stream, piece, start, end) of (stream, place, sample). A stream is one recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bounds = quiet_bounds(pdf.sort_values("place")["sample"].to_numpy(), target, search, width)
        return pd.DataFrame({"stream": pdf["stream"].iloc[0], "piece": range(len(bounds) - 1), "start": bounds[:-1], "end": bounds[1:]})

    return samples.select("stream", "place", "sample").groupBy("stream").applyInPandas(run, "stream long, piece long, start long, end long")


def operating_points(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(point, score, dir, far, frr): of a curve (score, dir, far, frr) the lowest threshold within each false alarm rate, and that where false alarms and false rejects are nearest.

    A threshold just above all scores, which accepts nothing, is on the curve too, so that there is always a point without false alarms; an empty curve has none.
    """
    # Without known trials, or without strangers, the rate of these is 0.
    rows = curve.select("score", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dir", "far", "frr")])
    some = curve.agg(F.max("score").alias("top"), F.max("frr").alias("known"))
    above = some.where("top is not null").select((F.col("top") + 1e-6).alias("score"), F.lit(0.0).alias("dir"), F.lit(0.0).alias("far"), F.when(F.col("known").isNotNull(), 1.0).otherwise(0.0).alias("frr"))
    every = rows.unionByName(above)
    named = [(f"far {t:g}", F.col("far") <= t, F.col("score")) for t in targets]
    parts = [every.where(fits).groupBy().agg(F.min_by(F.struct("score", "dir", "far", "frr"), F.struct(rank, "score")).alias("x")).select(F.lit(name).alias("point"), "x") for name, fits, rank in named]
    near = F.round(F.abs(F.col("far") - F.col("frr")), 9)
    parts.append(every.groupBy().agg(F.min_by(F.struct("score", "dir", "far", "frr"), F.struct(near, "score")).alias("x")).select(F.lit("equal error").alias("point"), "x"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("x is not null").select("point", "x.score", "x.dir", "x.far", "x.frr")


def biased_rates(rows: DataFrame, ref: str, hyp: str, rare: str, fed: str) -> DataFrame:
    """One row of error rates over all words, rare ones and others, and of how well the rare ones were found.

    ``rare`` are a row's words that count, ``fed`` those the decoder was given (the rare ones if there are none). A rare word that was heard
    inside a longer one is found loosely. A false insertion is a given word where the reference has another one, or none. Rates over nothing are null.
    """
    given = F.when(F.size(fed) > 0, F.col(fed)).otherwise(F.col(rare))
    steps = rows.select(ref, hyp, rare, given.alias("_fed"), F.explode(align(ref, hyp)).alias("s"))
    said, heard = F.get(F.col(ref), F.col("s.ref")), F.get(F.col(hyp), F.col("s.hyp"))
    match, replaced, extra = (F.col("s.step") == c for c in "msi")
    is_ref, rare_ref = ~extra, ~extra & F.array_contains(F.col(rare), said)
    wrong = F.col("s.step") != "m"
    rare_error = (rare_ref & wrong) | (extra & F.array_contains(F.col(rare), heard))
    counts = {
        "words": is_ref, "errors": wrong, "rare_words": rare_ref, "rare_errors": rare_error, "found": rare_ref & match,
        "found_loosely": rare_ref & (match | (replaced & heard.contains(said))), "false_insertions": (extra | replaced) & F.array_contains(F.col("_fed"), heard),
    }
    n = steps.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()])
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    plain = n.withColumn("_u", F.col("errors") - F.col("rare_errors")).withColumn("_uw", F.col("words") - F.col("rare_words")).withColumn("_hits", F.col("found") + F.col("false_insertions"))
    rated = plain.select(
        *counts, over("errors", "words").alias("wer"), over("_u", "_uw").alias("u_wer"), over("rare_errors", "rare_words").alias("b_wer"),
        over("found", "rare_words").alias("recall"), over("found_loosely", "rare_words").alias("recall_loose"), over("found", "_hits").alias("precision"),
    )
    return rated.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def display_names(entries: DataFrame, key: str, template: str) -> DataFrame:
    """``entries`` (key, speaker, start, seq) with labels of the form S and digits renamed by ``template`` (``{n}``), numbered by first appearance in their key; other labels stay."""
    raw = F.col("speaker").rlike("^S[0-9]+$")
    first = entries.where(raw).groupBy(key, "speaker").agg(F.min(F.struct("start", "seq")).alias("_f"))
    named = first.select(key, "speaker", F.replace(F.lit(template), F.lit("{n}"), F.row_number().over(W.partitionBy(key).orderBy("_f")).cast("string")).alias("_name"))
    return entries.join(named, [key, "speaker"], "left").withColumn("speaker", F.coalesce("_name", "speaker")).drop("_name")


def ordered_union(lists: DataFrame) -> DataFrame:
    """(term, rank) of (list, place, term): the lists one after the other, each in its order; of terms that are equal but for case the first stays."""
    rows = lists.where("trim(term) <> ''").withColumn("term", F.trim("term"))
    first = rows.groupBy(F.lower("term").alias("_k")).agg(F.min(F.struct("list", "place", "term")).alias("x"))
    # Ranks without one task for all: numbers within a list, after the counts of the lists before, which are few.
    counts = first.groupBy(F.col("x.list").alias("list")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("list", F.coalesce(F.sum("n").over(W.orderBy("list").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = first.select("x.list", "x.place", "x.term").withColumn("_n", F.row_number().over(W.partitionBy("list").orderBy("place", "term")))
    return numbered.join(F.broadcast(before), "list").select("term", (F.col("_before") + F.col("_n")).alias("rank"))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Text with composed letters."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def matched_devices(wanted: DataFrame, devices: DataFrame) -> DataFrame:
    """(ask, id, problem) for each (ask, name) against devices (id, name): the one of that id, else the only one of that name; several of a name are refused."""
    asks, known = wanted.select("ask", composed("name").alias("_w")), devices.select("id", composed("name").alias("_n"))
    by_id = asks.join(known.select("id", F.col("id").alias("_i")).distinct(), F.col("_w") == F.col("_i")).select("ask", "id")
    # Names are counted before they meet the asks, as many devices may share one that many ask for.
    names = known.distinct().groupBy("_n").agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("_d"))
    by_name = asks.join(names, F.col("_w") == F.col("_n")).groupBy("ask").agg(F.sum("_c").alias("_many"), F.min("_d").alias("_one"))
    joined = asks.join(by_id, "ask", "left").join(by_name, "ask", "left")
    found = F.coalesce("id", F.when(F.col("_many") == 1, F.col("_one")))
    problem = F.when(found.isNull(), F.when(F.col("_many") > 1, "ambiguous").otherwise("unknown"))
    return joined.select("ask", found.alias("id"), problem.alias("problem"))


def resolved_settings(layers: DataFrame, order: list[str], cleared: str = "<clear>") -> DataFrame:
    """(user, name, value, layer) of settings (user, layer, name, value): the first of the layers in ``order`` that gives a value. A layer that says ``cleared`` ends the search without a value."""
    place = F.coalesce(*[F.when(F.col("layer") == name, F.lit(i)) for i, name in enumerate(order)])
    first = layers.withColumn("_p", place).where("_p is not null and value is not null").groupBy("user", "name").agg(F.min_by(F.struct("value", "layer"), "_p").alias("x"))
    return first.select("user", "name", F.when(F.col("x.value") != cleared, F.col("x.value")).alias("value"), "x.layer")


def banner_channels(banner: Column) -> Column:
    """The number of channels that the first audio line of a decoder's banner tells by a count, or as mono or stereo; 1 if it tells none."""
    line = F.get(F.filter(F.split(banner, "\n"), lambda x: x.contains("Audio:")), F.lit(0))
    count = F.regexp_extract(line, r"([0-9]+) channels", 1)
    return F.when(count != "", count.try_cast("int")).when(line.rlike(r"\bstereo\b") & ~line.rlike(r"\bmono\b"), 2).otherwise(1)


def without_echo_if_armed(dropped: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """(key, lines, armed, kept) of lines (key, duplicate) and gaps (key, gap_s): the text backstop drops duplicate lines only where the reference had a gap, or where no gap is known."""
    per = dropped.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.count_if("duplicate").alias("_d")).join(gaps, key, "left")
    armed = F.col("gap_s").isNull() | (F.col("gap_s") > 0)
    return per.select(key, "lines", armed.alias("armed"), (F.col("lines") - F.when(armed, F.col("_d")).otherwise(0)).alias("kept"))


def reference_gaps(ticks: DataFrame, key: str) -> DataFrame:
    """(key, gap_s): seconds of ticks of 10 ms (key, tick, far) without a far frame; a key without any far frame is unknown (null)."""
    return ticks.groupBy(key).agg(F.count_if(F.col("far").isNull()).alias("_gone"), F.count("far").alias("_there")).select(key, F.when(F.col("_there") > 0, F.col("_gone") / 100.0).alias("gap_s"))


def solo_names(entries: DataFrame, vectors: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Entries (channel, speaker, ..) of channels that one person speaks on, with the name of the profile (model, profile, p) that the channel's only vector (model, trial, v) matches, if it reaches the threshold."""
    named = best_match(highest_scores(vectors, profiles), threshold).select(F.col("trial").alias("channel"), F.col("profile").cast("string").alias("_name"))
    return entries.join(named, "channel", "left").withColumn("speaker", F.coalesce("_name", "speaker")).drop("_name")


#: The least budget that leaves room for a prompt and a portion of the transcript.
LEAST_BUDGET = 4000


def note_plans(lines: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, n_chars, mode): whether all lines (key, text), joined by line feeds, fit into one prompt of ``budget`` characters (``single``) or go by portions (``portions``). A budget under ``LEAST_BUDGET`` fails."""
    if budget < LEAST_BUDGET:
        raise ValueError(f"a budget of {budget} characters is under {LEAST_BUDGET}")
    sizes = lines.groupBy(key).agg((F.sum(F.char_length("text") + 1) - 1).alias("n_chars"))
    return sizes.withColumn("mode", F.when(F.col("n_chars") <= budget, "single").otherwise("portions"))


def merged_frames(frames: DataFrame, key: str) -> DataFrame:
    """``frames`` (key, channel, at, seq, ..) with ``place``: the order in which all channels of a key are heard, by time and then by channel."""
    return frames.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("at", "channel", "seq")) - 1)


def words_of_range(rows: DataFrame, ref: str, hyp: str, start: Column, end: Column) -> DataFrame:
    """``rows`` with ``heard``: the words of ``hyp`` that the alignment puts beside the words of ``ref`` from ``start`` to before ``end``, and those inserted between two of these."""
    steps = rows.withColumn("_steps", align(ref, hyp)).withColumn("_a", start).withColumn("_b", end)
    # An insertion has the place of the reference word that follows it.
    inside = F.filter("_steps", lambda s: F.when(s["step"] == "i", (s["ref"] > F.col("_a")) & (s["ref"] < F.col("_b"))).otherwise((s["ref"] >= F.col("_a")) & (s["ref"] < F.col("_b")) & (s["step"] != "d")))
    return steps.withColumn("heard", F.transform(inside, lambda s: F.get(F.col(hyp), s["hyp"]))).drop("_steps", "_a", "_b")
