"""Queries on words and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals, matching, speech
from ..sources.derived import EVENTS_SQL, turns, words

COVER_SQL = f"""WITH {EVENTS_SQL},
hits AS (SELECT w.seq, w.channel, w.text, w.start_us, w.end_us, w.mid_us, t.speaker, least(t.end_us, w.end_us) - greatest(t.start_us, w.start_us) AS shared, t.start_us AS ts, t.seq AS tq
  FROM words w JOIN turns t ON w.channel = t.channel AND t.start_us <= w.mid_us AND w.mid_us < t.end_us),
covered AS (SELECT seq, channel, text, start_us, end_us, mid_us, arg_min(speaker, (-shared, ts, tq)) AS speaker, count(*) AS n_cover FROM hits GROUP BY seq, channel, text, start_us, end_us, mid_us)"""
ASSIGN_SQL = COVER_SQL + """,
rest AS (SELECT * FROM words WHERE seq NOT IN (SELECT seq FROM covered)),
before AS (SELECT r.seq, max(t.end_us) AS t, arg_max(t.speaker, (t.end_us, -t.start_us, -t.seq)) AS speaker FROM rest r JOIN turns t ON r.channel = t.channel AND t.end_us <= r.mid_us GROUP BY r.seq),
after AS (SELECT r.seq, min(t.start_us) AS t, arg_min(t.speaker, (t.start_us, t.seq)) AS speaker FROM rest r JOIN turns t ON r.channel = t.channel AND t.start_us > r.mid_us GROUP BY r.seq),
near AS (SELECT r.*, CASE WHEN b.t IS NOT NULL AND (a.t IS NULL OR r.mid_us - b.t <= a.t - r.mid_us) THEN b.speaker ELSE coalesce(a.speaker, 'S0') END AS speaker
  FROM rest r LEFT JOIN before b USING (seq) LEFT JOIN after a USING (seq)),
assigned AS (SELECT seq, channel, text, start_us, end_us, mid_us, speaker, n_cover > 1 AS provisional FROM covered UNION ALL SELECT seq, channel, text, start_us, end_us, mid_us, speaker, false FROM near)"""
RUNS_SQL = ASSIGN_SQL + """,
opens AS (SELECT *, CASE WHEN lag(end_us) OVER o IS NULL OR start_us - lag(end_us) OVER o > 1500000 OR lag(speaker) OVER o <> speaker THEN 1 ELSE 0 END AS op FROM assigned WINDOW o AS (PARTITION BY channel ORDER BY start_us, seq)),
runs AS (SELECT *, sum(op) OVER (PARTITION BY channel ORDER BY start_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM opens),
made AS (SELECT channel, CAST(run AS BIGINT) AS run, speaker, string_agg(text, ' ' ORDER BY start_us, seq) AS text, arg_min(start_us, (start_us, seq)) AS start_us, arg_max(end_us, (start_us, seq)) AS end_us, bool_or(provisional) AS provisional, count(*) AS n_words FROM runs GROUP BY channel, run, speaker)"""


def jn01_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01: the covering turn of each word's middle."""
    return speech.cover(words(spark, sf_dir), turns(spark, sf_dir)).select("seq", "channel", "speaker", "n_cover", "provisional")


def jn02_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-02: all words by cover, else nearest turn."""
    return speech.assign(words(spark, sf_dir), turns(spark, sf_dir)).select("seq", "channel", "speaker", "provisional")


def m0_speaker_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-01 + JN-02 + WN-01 + PRJ-08: speaker-labelled entries with labels by first appearance."""
    made = speech.to_entries(speech.sessions(speech.assign(words(spark, sf_dir), turns(spark, sf_dir))))
    return speech.first_appearance(made, "speaker", ["start_us", "run"], ["channel"]).withColumn("label", F.concat(F.lit("S"), "rank")).drop("rank")


def wn01_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-01: runs of words that close on a speaker change or a gap."""
    made = speech.sessions(speech.assign(words(spark, sf_dir), turns(spark, sf_dir)))
    return made.select("seq", "channel", "speaker", F.col("run").cast("long").alias("run"))


def wn02_gap_sessions_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-02: the same without speakers."""
    made = speech.sessions(words(spark, sf_dir), speaker=None)
    return made.groupBy("channel", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("n_words")).withColumn("run", F.col("run").cast("long"))


def jn04_most_shared_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-04: the speaker with whose turn a word shares most time, if any."""
    w = words(spark, sf_dir).select("seq", "channel", "start_us", "end_us")
    t = turns(spark, sf_dir).select("channel", "speaker", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"), F.col("seq").alias("t_seq"))
    both = intervals.overlap(w, t, ["channel"], ("start_us", "end_us"), ("t_start", "t_end"), speech.BIN_US)
    return both.groupBy("seq").agg(F.min_by("speaker", F.struct(-F.col("shared"), "t_start", "t_seq")).alias("speaker"), F.max("shared").alias("shared"))


def jn05_dominant_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05: per channel and word text, the speaker with most shared time."""
    w = words(spark, sf_dir).select("channel", "text", "start_us", "end_us")
    t = turns(spark, sf_dir).select("channel", "speaker", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    both = intervals.overlap(w, t, ["channel"], ("start_us", "end_us"), ("t_start", "t_end"), speech.BIN_US)
    sums = both.groupBy("channel", "text", "speaker").agg(F.sum("shared").alias("shared"))
    return sums.groupBy("channel", "text").agg(F.min_by("speaker", F.struct(-F.col("shared"), "speaker")).alias("speaker"), F.max("shared").alias("shared"))


def jn06_span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06: microseconds that words and turns of a channel share, over all pairs."""
    w = words(spark, sf_dir).select("channel", "start_us", "end_us")
    t = turns(spark, sf_dir).select("channel", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    return intervals.overlap(w, t, ["channel"], ("start_us", "end_us"), ("t_start", "t_end"), speech.BIN_US).groupBy("channel").agg(F.sum("shared").alias("shared"))


def jn12_window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12: words whose middle lies in a turn, both ends included."""
    t = turns(spark, sf_dir).select("channel", F.col("seq").alias("turn"), F.col("start_us").alias("t_start"), (F.col("end_us") + 1).alias("t_end"))
    found = intervals.stab(words(spark, sf_dir), t, ["channel"], "mid_us", "t_start", "t_end", speech.BIN_US)
    return found.groupBy("turn").agg(F.count(F.lit(1)).alias("n_words"))


def jn14_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14 and SO-01: words and turns of a channel on one timeline, words first on ties."""
    tag = lambda df, kind, rank: df.select("channel", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "seq", "start_us", "end_us")
    rows = tag(words(spark, sf_dir), "word", 0).unionByName(tag(turns(spark, sf_dir), "turn", 1))
    place = F.row_number().over(W.partitionBy("channel").orderBy("start_us", "end_us", "rank", "seq"))
    return rows.withColumn("place", place.cast("long")).drop("rank")


def ag01_speech_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-01: speech per channel and speaker."""
    return turns(spark, sf_dir).groupBy("channel", "speaker").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"))


def ag04_detected_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-04: distinct speakers of a channel."""
    return turns(spark, sf_dir).groupBy("channel").agg(F.countDistinct("speaker").alias("speakers"))


def prj03_claim_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03 and PRJ-04: where a turn's decode starts, and its context."""
    order = W.partitionBy("channel").orderBy("start_us", "seq")
    previous = F.lag("end_us", 1, 0).over(order)
    context = F.when(F.col("end_us") - F.col("start_us") < 8_000_000, F.greatest(F.lit(0), F.col("start_us") - 15_000_000)).otherwise(F.col("start_us"))
    return turns(spark, sf_dir).select("seq", F.greatest(F.col("start_us") - 300_000, previous).alias("claim_us"), context.cast("long").alias("context_us"))


def wn08_token_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-08: a token ends where the next starts, 0.32 s after its start at most."""
    order = W.partitionBy("channel").orderBy("start_us", "seq")
    return words(spark, sf_dir).select("seq", F.least(F.lead("start_us").over(order), F.col("start_us") + 320_000).alias("token_end_us"))


def wn12_merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-12: turns of a channel united over gaps of 0.3 s at most."""
    return intervals.merge_gaps(turns(spark, sf_dir).select("channel", "start_us", "end_us"), ["channel"], "start_us", "end_us", 300_000)


def wn11_frames_to_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-11: a speaker's turns united over gaps of 0.5 s at most; those over 0.3 s are kept."""
    merged = intervals.merge_gaps(turns(spark, sf_dir).select("channel", "speaker", "start_us", "end_us"), ["channel", "speaker"], "start_us", "end_us", 500_000)
    return merged.where("end_us - start_us > 300000")


def wn16_first_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-16: each channel's turns cut to its first 5 s of speech."""
    order = W.partitionBy("channel").orderBy("start_us", "seq").rowsBetween(W.unboundedPreceding, -1)
    rows = turns(spark, sf_dir).withColumn("used", F.coalesce(F.sum(F.col("end_us") - F.col("start_us")).over(order), F.lit(0)))
    return rows.where("used < 5000000").select("seq", "channel", "start_us", F.least(F.col("end_us"), F.col("start_us") + 5_000_000 - F.col("used")).alias("end_us"))


def wn22_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-22 and SM-05: words by arrival; one that starts before an earlier one is dropped."""
    order = W.partitionBy("channel").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    latest = F.max("start_us").over(order)
    return words(spark, sf_dir).withColumn("latest", latest).where("latest is null or start_us + 1 >= latest").select("seq", "channel", "start_us")


def st09_overlapped_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-09 and SE-06: stretches where two speakers or more talk, after uniting each speaker's own turns."""
    own = intervals.merge_gaps(turns(spark, sf_dir).select("channel", "speaker", "start_us", "end_us"), ["channel", "speaker"], "start_us", "end_us", 0)
    return intervals.depth(own, ["channel"], "start_us", "end_us").where("depth >= 2")


def st10_clean_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-10 and SE-05: each speaker's speech outside stretches where several talk."""
    own = intervals.merge_gaps(turns(spark, sf_dir).select("channel", "speaker", "start_us", "end_us"), ["channel", "speaker"], "start_us", "end_us", 0)
    cuts = intervals.depth(own, ["channel"], "start_us", "end_us").where("depth >= 2").select("channel", F.col("start_us"), F.col("end_us"))
    per = cuts.join(own.select("channel", "speaker").distinct(), "channel")
    return intervals.subtract(own, per, ["channel", "speaker"], "start_us", "end_us")


def st13_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-13: active 10 ms frames per channel and speaker, frames rounded half to even, the last one excluded."""
    spans = matching.frame_spans(turns(spark, sf_dir))
    return spans.groupBy("channel", "speaker").agg(F.sum(F.col("high") - F.col("low")).alias("frames"))


def ev04_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-04: per channel by arrival, starts that go back, ends before starts, and spans past the last turn plus a second."""
    order = W.partitionBy("channel").orderBy("seq")
    limits = turns(spark, sf_dir).groupBy("channel").agg((F.max("end_us") + 1_000_000).alias("limit_us"))
    rows = words(spark, sf_dir).withColumn("back", F.coalesce(F.col("start_us") < F.lag("start_us").over(order), F.lit(False))).join(limits, "channel", "left")
    return rows.groupBy("channel").agg(
        F.count_if("back").alias("backward"), F.count_if(F.col("end_us") < F.col("start_us")).alias("negative"),
        F.count_if(F.coalesce(F.col("end_us") > F.col("limit_us"), F.lit(True))).alias("outside"),
    )


_W = f"WITH {EVENTS_SQL}"
_MERGED = """{name}_o AS (SELECT *, CASE WHEN max(end_us) OVER o IS NULL OR start_us - max(end_us) OVER o > {gap} THEN 1 ELSE 0 END AS op FROM {src} WINDOW o AS (PARTITION BY {key} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_r AS (SELECT *, sum(op) OVER (PARTITION BY {key} ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM {name}_o),
{name} AS (SELECT {key}, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_r GROUP BY {key}, run)"""
_OWN = _W + ", " + _MERGED.format(name="own", gap=0, src="turns", key="channel, speaker") + """,
edges AS (SELECT channel, t, sum(d) AS d FROM (SELECT channel, start_us AS t, 1 AS d FROM own UNION ALL SELECT channel, end_us, -1 FROM own) GROUP BY channel, t),
steps AS (SELECT channel, t AS start_us, lead(t) OVER o AS end_us, CAST(sum(d) OVER o AS BIGINT) AS depth FROM edges WINDOW o AS (PARTITION BY channel ORDER BY t))"""

QUERIES = {f.__name__: f for f in (
    m0_speaker_entries, jn01_cover, jn02_nearest, wn01_gap_sessions, wn02_gap_sessions_plain, jn04_most_shared_turn, jn05_dominant_speaker, jn06_span_overlap, jn12_window_members,
    jn14_interleave, ag01_speech_duration, ag04_detected_speakers, prj03_claim_start, wn08_token_ends, wn12_merge_spans, wn11_frames_to_turns, wn16_first_seconds, wn22_append_only,
    st09_overlapped_speech, st10_clean_speech, st13_activity, ev04_sanity,
)}
ORACLE_SQL = {
    "m0_speaker_entries": RUNS_SQL + """,
firsts AS (SELECT channel, speaker, min((start_us, run)) AS f FROM made GROUP BY channel, speaker),
ranks AS (SELECT channel, speaker, row_number() OVER (PARTITION BY channel ORDER BY f) AS rank FROM firsts)
SELECT made.*, 'S' || rank AS label FROM made JOIN ranks USING (channel, speaker)""",
    "jn01_cover": COVER_SQL + " SELECT seq, channel, speaker, n_cover, n_cover > 1 AS provisional FROM covered",
    "jn02_nearest": ASSIGN_SQL + " SELECT seq, channel, speaker, provisional FROM assigned",
    "wn01_gap_sessions": RUNS_SQL + " SELECT seq, channel, speaker, CAST(run AS BIGINT) AS run FROM runs",
    "wn02_gap_sessions_plain": _W + """, o AS (SELECT *, CASE WHEN lag(end_us) OVER w IS NULL OR start_us - lag(end_us) OVER w > 1500000 THEN 1 ELSE 0 END AS op FROM words WINDOW w AS (PARTITION BY channel ORDER BY start_us, seq)),
r AS (SELECT *, CAST(sum(op) OVER (PARTITION BY channel ORDER BY start_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM o) SELECT channel, run, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words FROM r GROUP BY channel, run""",
    "jn04_most_shared_turn": _W + """, p AS (SELECT w.seq, t.speaker, least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us) AS shared, t.start_us AS ts, t.seq AS tq FROM words w JOIN turns t ON w.channel = t.channel AND w.start_us < t.end_us AND t.start_us < w.end_us)
SELECT seq, arg_min(speaker, (-shared, ts, tq)) AS speaker, max(shared) AS shared FROM p GROUP BY seq""",
    "jn05_dominant_speaker": _W + """, p AS (SELECT w.channel, w.text, t.speaker, CAST(sum(least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us)) AS BIGINT) AS shared FROM words w JOIN turns t ON w.channel = t.channel AND w.start_us < t.end_us AND t.start_us < w.end_us GROUP BY w.channel, w.text, t.speaker)
SELECT channel, text, arg_min(speaker, (-shared, speaker)) AS speaker, max(shared) AS shared FROM p GROUP BY channel, text""",
    "jn06_span_overlap": _W + " SELECT w.channel, CAST(sum(least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us)) AS BIGINT) AS shared FROM words w JOIN turns t ON w.channel = t.channel AND w.start_us < t.end_us AND t.start_us < w.end_us GROUP BY w.channel",
    "jn12_window_members": _W + " SELECT t.seq AS turn, count(*) AS n_words FROM words w JOIN turns t ON w.channel = t.channel AND w.mid_us BETWEEN t.start_us AND t.end_us GROUP BY t.seq",
    "jn14_interleave": _W + """, u AS (SELECT channel, 'word' AS kind, 0 AS rank, seq, start_us, end_us FROM words UNION ALL SELECT channel, 'turn', 1, seq, start_us, end_us FROM turns)
SELECT channel, kind, seq, start_us, end_us, row_number() OVER (PARTITION BY channel ORDER BY start_us, end_us, rank, seq) AS place FROM u""",
    "ag01_speech_duration": _W + " SELECT channel, speaker, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us FROM turns GROUP BY channel, speaker",
    "ag04_detected_speakers": _W + " SELECT channel, count(DISTINCT speaker) AS speakers FROM turns GROUP BY channel",
    "prj03_claim_start": _W + " SELECT seq, greatest(start_us - 300000, lag(end_us, 1, 0) OVER (PARTITION BY channel ORDER BY start_us, seq)) AS claim_us, CASE WHEN end_us - start_us < 8000000 THEN greatest(0, start_us - 15000000) ELSE start_us END AS context_us FROM turns",
    "wn08_token_ends": _W + " SELECT seq, least(lead(start_us) OVER (PARTITION BY channel ORDER BY start_us, seq), start_us + 320000) AS token_end_us FROM words",
    "wn12_merge_spans": _W + ", " + _MERGED.format(name="m", gap=300000, src="turns", key="channel") + " SELECT channel, start_us, end_us FROM m",
    "wn11_frames_to_turns": _W + ", " + _MERGED.format(name="m", gap=500000, src="turns", key="channel, speaker") + " SELECT * FROM m WHERE end_us - start_us > 300000",
    "wn16_first_seconds": _W + """, u AS (SELECT *, coalesce(sum(end_us - start_us) OVER (PARTITION BY channel ORDER BY start_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM turns)
SELECT seq, channel, start_us, CAST(least(end_us, start_us + 5000000 - used) AS BIGINT) AS end_us FROM u WHERE used < 5000000""",
    "wn22_append_only": _W + """, u AS (SELECT *, max(start_us) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM words)
SELECT seq, channel, start_us FROM u WHERE latest IS NULL OR start_us + 1 >= latest""",
    "st09_overlapped_speech": _OWN + " SELECT channel, start_us, end_us, depth FROM steps WHERE depth >= 2 AND end_us IS NOT NULL",
    "st10_clean_speech": _OWN + """, pieces AS (SELECT o.channel, o.speaker, s.start_us, s.end_us FROM own o JOIN steps s ON o.channel = s.channel AND s.depth = 1 AND s.start_us >= o.start_us AND s.end_us <= o.end_us),
""" + _MERGED.format(name="m", gap=0, src="pieces", key="channel, speaker") + " SELECT channel, speaker, start_us, end_us FROM m",
    "st13_activity": _W + """, s AS (SELECT channel, speaker, CAST(round_even(start_us / 10000.0, 0) AS BIGINT) AS low, CAST(round_even(end_us / 10000.0, 0) AS BIGINT) AS high FROM turns),
f AS (SELECT DISTINCT channel, speaker, unnest(range(low, high)) AS frame FROM s) SELECT channel, speaker, count(*) AS frames FROM f GROUP BY channel, speaker""",
    "ev04_sanity": _W + """, l AS (SELECT channel, max(end_us) + 1000000 AS limit_us FROM turns GROUP BY channel),
b AS (SELECT w.*, coalesce(start_us < lag(start_us) OVER (PARTITION BY w.channel ORDER BY seq), false) AS back, limit_us FROM words w LEFT JOIN l USING (channel))
SELECT channel, count(*) FILTER (back) AS backward, count(*) FILTER (end_us < start_us) AS negative, count(*) FILTER (coalesce(end_us > limit_us, true)) AS outside FROM b GROUP BY channel""",
}
