"""Queries that align, correct and score, and those on budgeted windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, matching, speech, windows
from ..sources.derived import ENTRIES_SQL, EVENTS_SQL, entries, read, turns, words
from .speech import _MERGED, RUNS_SQL
from .streams import PADDED_SQL


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference words of conversation turns, and what was heard: words whose length is a multiple of 5 are lost, and every ninth is changed."""
    ref = T.plain_words(F.coalesce("text", F.lit("")))
    heard = F.transform(F.filter("ref", lambda w: F.char_length(w) % 5 != 0), lambda w, i: F.when(i % 9 == 8, F.concat(w, F.lit("x"))).otherwise(w))
    # Aligning takes milliseconds a turn, so turns are spread by number, not by size: texts that compress well are read in few tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition(parts, "conv_id", "turn")
    return rows.select("conv_id", "turn", ref.alias("ref")).withColumn("hyp", heard)


def ag11_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11 and FN-11: errors of each conversation turn under the weighted alignment."""
    made = matching.error_counts(_pairs(spark, sf_dir), "ref", "hyp")
    return made.select("conv_id", "turn", "matches", "substitutions", "insertions", "deletions", F.round("wer", 6).alias("wer"))


def ag10_biased_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-10 and FN-14: errors among long words and among the others."""
    rows = _pairs(spark, sf_dir).withColumn("biased", F.filter("ref", lambda w: F.char_length(w) > 8))
    return matching.biased_counts(rows, "ref", "hyp", "biased")


def fn12_changed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12, WN-13 and AG-23: regions of a turn where reference and heard words differ, those at most two words apart united."""
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", F.explode(matching.opcodes("ref", "hyp")).alias("o")).where("o.tag <> 'equal'")
    order = W.partitionBy("conv_id", "turn").orderBy("o.i1", "o.j1")
    opens = F.coalesce(F.col("o.i1") - F.lag("o.i2").over(order) > 2, F.lit(True)).cast("int")
    runs = rows.withColumn("_b", opens).withColumn("region", F.sum("_b").over(order))
    return runs.groupBy("conv_id", "turn", "region").agg(F.min("o.i1").alias("i1"), F.max("o.i2").alias("i2"), F.min("o.j1").alias("j1"), F.max("o.j2").alias("j2"))


def jn03_without_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03 and FN-10: turns of users that do not repeat another role's turn within 2 s; every seventh turn is made an echo first."""
    rows = entries(spark, sf_dir)
    before = F.lag("text").over(W.partitionBy("meeting").orderBy("seq"))
    rows = rows.withColumn("text", F.when((F.col("seq") % 7 == 2) & before.isNotNull(), before).otherwise(F.col("text")))
    mic, system = rows.where("speaker = 'user'"), rows.where("speaker <> 'user'")
    return matching.without_echo(mic, system, T.plain_words(F.col("text"))).select("meeting", "seq")


def fn09_fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-09: likeness of each benchmark item with the next."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text")
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("after"))
    return rows.join(after, "item_id").select("item_id", F.round(matching.ratio("text", "after"), 6).alias("ratio"))


def tx03_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-01, TX-02, TX-03 and EV-12: each conversation turn corrected by terms of its own: its words of twelve letters and more, each misheard by one letter."""
    rows = _pairs(spark, sf_dir)
    terms = F.array_sort(F.array_distinct(F.filter("ref", lambda w: F.char_length(w) >= 12)))
    heard = F.transform("ref", lambda w: F.when(F.char_length(w) >= 12, F.concat(F.substring(w, 1, 6), F.substring(w, 8, 1000))).otherwise(w))
    given = rows.select("conv_id", "turn", terms.alias("terms"), heard.alias("ws"))
    return matching.correct(given, "ws", "terms", 0.9).select("conv_id", "turn", F.array_join("ws", " ").alias("text"))


def _heard_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a diarizer might give them: every tenth lost, all 50 ms late, every seventh under another name."""
    rows = turns(spark, sf_dir).where("seq % 20 <> 0")
    name = F.when(F.col("seq") % 14 == 0, F.lit("other")).otherwise(F.concat(F.lit("h_"), "speaker"))
    return rows.select("seq", "channel", name.alias("speaker"), (F.col("start_us") + 50_000).alias("start_us"), (F.col("end_us") + 50_000).alias("end_us"))


def ag12_diarization_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-12, ST-12, ST-13 and CL-03: missed, false-alarm and confused frames per channel."""
    return matching.diarization_errors(turns(spark, sf_dir), _heard_turns(spark, sf_dir))


def ag12_missed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-12 without the naming: reference, missed and false-alarm frames per channel."""
    ref = turns(spark, sf_dir)
    sums = matching.diarization_sums(matching.frame_spans(ref), matching.frame_spans(_heard_turns(spark, sf_dir)), matching.collar_spans(ref))
    return sums.select("channel", "ref_frames", "missed", "false_alarm")


def ag13_word_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-13: per channel, words, and words whose heard speaker is the best partner of the reference one."""
    w = words(spark, sf_dir)
    ref, hyp = speech.assign(w, turns(spark, sf_dir)), speech.assign(w, _heard_turns(spark, sf_dir))
    both = ref.select("seq", "channel", F.col("speaker").alias("r")).join(hyp.select("seq", F.col("speaker").alias("h")), "seq")
    counted = both.groupBy("channel", "r", "h").agg(F.count(F.lit(1)).alias("n"))

    return matching.best_partners(counted, "channel", "r", "h").select("channel", F.col("total").alias("n_words"), F.col("matched").alias("right"))


def wn03_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-03: decode windows over the united turns of a channel."""
    segments = intervals.merge_gaps(turns(spark, sf_dir).select("channel", "start_us", "end_us"), ["channel"], "start_us", "end_us", 0)
    return windows.pack_windows(segments, F.max("end_us") + 1_000_000)


def wn04_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-04 and SO-02: subtitle cues of speaker-labelled entries."""
    runs = speech.sessions(speech.assign(words(spark, sf_dir), turns(spark, sf_dir)))
    ordered = F.array_sort(F.collect_list(F.struct("start_us", "seq", "end_us", "text")))
    grouped = runs.groupBy("channel", "run", "speaker").agg(ordered.alias("ws"))
    ws = F.transform("ws", lambda w: F.struct(w["start_us"].alias("start_us"), w["end_us"].alias("end_us"), w["text"].alias("text")))
    return windows.cues(grouped.select("channel", "run", "speaker", ws.alias("ws")), ["channel", "run"])


def wn05_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-05: conversation turns wrapped at 42 characters."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.wrap(F.coalesce("text", F.lit(""))).alias("wrapped"))


def wn10_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-10 and EV-21: runs of active frames per channel and speaker."""
    return matching.frame_spans(turns(spark, sf_dir)).select("channel", "speaker", F.col("low").alias("start"), F.col("high").alias("end"))


def wn15_padded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-15: united turns widened by 0.25 s, clamped by their neighbours."""
    merged = intervals.merge_gaps(turns(spark, sf_dir).select("channel", "start_us", "end_us"), ["channel"], "start_us", "end_us", 0)
    return windows.padded_turns(merged, 250_000)


def wn17_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-17 and NT-01: each meeting's lines in chunks of 4,000 characters."""
    lines = entries(spark, sf_dir).select("meeting", "seq", F.concat("speaker", F.lit(": "), "text").alias("text"))
    return windows.chunks(lines, "meeting", 4000).select("meeting", "chunk", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def wn19_top_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-18 and WN-19: per channel and second, as many speakers with most frames as talk at once on average (half rounds up)."""
    spans = matching.frame_spans(turns(spark, sf_dir))

    def per_second(rows: DataFrame, *key: str) -> DataFrame:
        """Active frames of each second that a span touches."""
        second = F.explode(F.sequence(F.floor(F.col("low") / 100).cast("long"), F.floor((F.col("high") - 1) / 100).cast("long"))).alias("second")
        n = F.least("high", F.col("second") * 100 + 100) - F.greatest("low", F.col("second") * 100)
        return rows.select(*key, "low", "high", second).groupBy(*key, "second").agg(F.sum(n).alias("votes"))

    votes = per_second(spans, "channel", "speaker")
    some = per_second(intervals.merge_gaps(spans.select("channel", "low", "high"), ["channel"], "low", "high", 0), "channel").withColumnRenamed("votes", "frames")
    talk = votes.groupBy("channel", "second").agg(F.sum("votes").alias("votes"))
    wanted = talk.join(some, ["channel", "second"]).select("channel", "second", F.floor(F.col("votes") / F.col("frames") + 0.5).cast("int").alias("k"))
    rank = F.row_number().over(W.partitionBy("channel", "second").orderBy(F.desc("votes"), "speaker"))
    return votes.withColumn("rank", rank).join(wanted, ["channel", "second"]).where("rank <= k").select("channel", "second", "speaker", "votes")


def ag19_commit_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-19: per channel, median and 90th percentile of the wait between words by arrival, the longest, and steps back."""
    order = W.partitionBy("channel").orderBy("seq")
    rows = words(spark, sf_dir).withColumn("wait", F.col("start_us") - F.lag("start_us").over(order)).where("wait is not null")
    return rows.groupBy("channel").agg(
        F.expr("percentile_disc(0.5) within group (order by wait)").cast("long").alias("p50"), F.expr("percentile_disc(0.9) within group (order by wait)").cast("long").alias("p90"),
        F.max("wait").alias("longest"), F.count_if(F.col("wait") < 0).alias("back"),
    )


def ag17_envelope_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17 and FN-26: correlation of the hourly root mean square of two halves of the users, and whether they are independent."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    per = read(spark, sf_dir, "events").groupBy(hour.alias("hour"), (F.col("user_id") % 2).alias("side")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    sides = per.groupBy("hour").agg(F.max(F.when(F.col("side") == 0, F.col("rms"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("rms"))).alias("b")).fillna(0.0)
    r = F.corr("a", "b")
    return sides.agg(F.round(r, 5).alias("r"), (r < 0.5).alias("independent"))


def cl04_top_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL-04: the coordinate with the greatest value of each vector's 64, as the set of six labels whose bits it has."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    top = F.array_position("x", F.array_max("x")).cast("int") - 1
    return rows.select("vec_id", top.alias("top"), *[(top.bitwiseAND(1 << b) > 0).alias(f"label_{b}") for b in range(6)])


def nt02_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NT-02 and FN-20: whether a page's lines hold a list item, and its length without think blocks."""
    text = F.coalesce("html", F.lit(""))
    gate = F.exists(F.split(text, "\n"), lambda line: line.rlike(r"^\s*([-*+]|<li)"))
    return read(spark, sf_dir, "pages").select("page_id", gate.alias("has_items"), F.char_length(T.without_reasoning(text)).alias("n_chars"))


_W = f"WITH {EVENTS_SQL}"
_FRAMES = """{n}_s AS (SELECT channel, speaker, greatest(0, CAST(round_even(start_us / 10000.0, 0) AS BIGINT)) AS low, greatest(0, CAST(round_even(end_us / 10000.0, 0) AS BIGINT)) AS high FROM {src}),
{n} AS (SELECT DISTINCT channel, speaker, unnest(range(low, high)) AS frame FROM {n}_s)"""
QUERIES = {f.__name__: f for f in (
    ag10_biased_errors, ag11_word_errors, fn12_changed_regions, jn03_without_echo, fn09_fuzzy_ratio, tx03_glossary, ag12_diarization_errors, ag12_missed_frames, ag13_word_attribution,
    wn03_pack_windows, wn04_cues, wn05_wrap, wn10_islands, wn15_padded_turns, wn17_chunks, wn19_top_votes, ag19_commit_latency, ag17_envelope_correlation, cl04_top_class, nt02_gate,
)}
ORACLE_SQL = {
    "wn04_cues": RUNS_SQL.replace("WITH", "WITH RECURSIVE", 1) + """,
ws AS (SELECT channel, CAST(run AS BIGINT) AS run, speaker, text, start_us, end_us, row_number() OVER (PARTITION BY channel, run ORDER BY start_us, seq) AS i FROM runs),
f AS (SELECT channel, run, speaker, i, 0::INTEGER AS seq, start_us, end_us, text FROM ws WHERE i = 1
  UNION ALL
  SELECT channel, run, speaker, i, CASE WHEN goes THEN cue ELSE cue + 1 END, CASE WHEN goes THEN s0 ELSE start_us END, end_us, CASE WHEN goes THEN t0 || ' ' || text ELSE text END
  FROM (SELECT w.*, f.seq AS cue, f.start_us AS s0, f.text AS t0, length(f.text) + 1 + length(w.text) <= 84 AND w.end_us - f.start_us <= 6000000 AND w.start_us - f.end_us <= 1000000 AS goes FROM f JOIN ws w ON w.channel = f.channel AND w.run = f.run AND w.i = f.i + 1))
SELECT channel, run, speaker, seq, min(start_us) AS start_us, arg_max(end_us, i) AS end_us, arg_max(text, i) AS text FROM f GROUP BY channel, run, speaker, seq""",
    "wn17_chunks": f"""WITH RECURSIVE {ENTRIES_SQL}, l AS (SELECT meeting, speaker || ': ' || text AS t, row_number() OVER (PARTITION BY meeting ORDER BY seq) AS i FROM entries),
r AS (SELECT meeting, i, t, 0 AS chunk, length(t) AS n FROM l WHERE i = 1
  UNION ALL
  SELECT l.meeting, l.i, l.t, CASE WHEN r.n + 1 + length(l.t) <= 4000 THEN chunk ELSE chunk + 1 END, CASE WHEN r.n + 1 + length(l.t) <= 4000 THEN r.n + 1 + length(l.t) ELSE length(l.t) END FROM r JOIN l ON l.meeting = r.meeting AND l.i = r.i + 1)
SELECT meeting, chunk, length(string_agg(t, chr(10) ORDER BY i)) AS n_chars, sha256(string_agg(t, chr(10) ORDER BY i)) AS sha256 FROM r GROUP BY meeting, chunk""",
    "wn05_wrap": """SELECT conv_id, turn, rtrim(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '(\\S{43,}|.{1,42})( |$)', '\\1' || chr(10), 'g'), chr(10)) AS wrapped FROM conversations""",
    "wn03_pack_windows": PADDED_SQL,
    "ag12_missed_frames": _W + """, heard AS (SELECT channel, CASE WHEN seq % 14 = 0 THEN 'other' ELSE 'h_' || speaker END AS speaker, start_us + 50000 AS start_us, end_us + 50000 AS end_us FROM turns WHERE seq % 20 <> 0),
""" + _FRAMES.format(n="rf", src="turns") + ", " + _FRAMES.format(n="hf", src="heard") + """,
b AS (SELECT DISTINCT channel, CAST(round_even(unnest([start_us, end_us]) / 10000.0, 0) AS BIGINT) AS b FROM turns), m AS (SELECT DISTINCT channel, unnest(range(b - 25, b + 25)) AS frame FROM b),
r AS (SELECT channel, frame, count(*) AS n FROM rf ANTI JOIN m USING (channel, frame) GROUP BY channel, frame), h AS (SELECT channel, frame, count(*) AS n FROM hf ANTI JOIN m USING (channel, frame) GROUP BY channel, frame),
j AS (SELECT channel, coalesce(r.n, 0) AS a, coalesce(h.n, 0) AS z FROM r FULL JOIN h USING (channel, frame))
SELECT channel, CAST(sum(a) AS BIGINT) AS ref_frames, CAST(sum(greatest(a - z, 0)) AS BIGINT) AS missed, CAST(sum(greatest(z - a, 0)) AS BIGINT) AS false_alarm FROM j GROUP BY channel""",
    "wn10_islands": _W + ", " + _FRAMES.format(n="f", src="turns") + """,
i AS (SELECT *, frame - row_number() OVER (PARTITION BY channel, speaker ORDER BY frame) AS g FROM f) SELECT channel, speaker, min(frame) AS start, max(frame) + 1 AS "end" FROM i GROUP BY channel, speaker, g""",
    "wn15_padded_turns": _W + ", " + _MERGED.format(name="m", gap=0, src="turns", key="channel") + """
SELECT channel, greatest(start_us - 250000, coalesce(least(lag(end_us) OVER o, start_us), 0)) AS start_us, least(end_us + 250000, coalesce(greatest(lead(start_us) OVER o, end_us), end_us + 250000)) AS end_us FROM m WINDOW o AS (PARTITION BY channel ORDER BY start_us, end_us)""",
    "wn19_top_votes": _W + ", " + _FRAMES.format(n="f", src="turns") + """,
v AS (SELECT channel, frame // 100 AS second, speaker, count(*) AS votes FROM f GROUP BY ALL), c AS (SELECT channel, frame // 100 AS second, frame, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT channel, second, floor(avg(n) + 0.5) AS k FROM c GROUP BY channel, second), q AS (SELECT *, row_number() OVER (PARTITION BY channel, second ORDER BY votes DESC, speaker) AS rank FROM v)
SELECT channel, second, speaker, votes FROM q JOIN k USING (channel, second) WHERE rank <= k""",
    "ag19_commit_latency": _W + """, d AS (SELECT channel, start_us - lag(start_us) OVER (PARTITION BY channel ORDER BY seq) AS wait FROM words)
SELECT channel, quantile_disc(wait, 0.5) AS p50, quantile_disc(wait, 0.9) AS p90, max(wait) AS longest, count(*) FILTER (wait < 0) AS back FROM d WHERE wait IS NOT NULL GROUP BY channel""",
    "ag17_envelope_correlation": """WITH p AS (SELECT date_trunc('hour', ts) AS hour, user_id % 2 AS side, sqrt(avg(value * value)) AS rms FROM events GROUP BY ALL),
s AS (SELECT hour, coalesce(max(rms) FILTER (side = 0), 0.0) AS a, coalesce(max(rms) FILTER (side = 1), 0.0) AS b FROM p GROUP BY hour) SELECT round(corr(a, b), 5) AS r, corr(a, b) < 0.5 AS independent FROM s""",
    "cl04_top_class": f"""WITH t AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS top FROM embeddings) SELECT vec_id, top, {', '.join(f"top & {1 << b} > 0 AS label_{b}" for b in range(6))} FROM t""",
    "nt02_gate": """SELECT page_id, len(list_filter(string_split(coalesce(html, ''), chr(10)), lambda l: regexp_matches(l, '^\\s*([-*+]|<li)'))) > 0 AS has_items,
length(trim(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '', 'g'))) AS n_chars FROM pages""",
}
