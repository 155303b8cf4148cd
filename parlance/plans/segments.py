"""Queries on decoded segments, names and galleries of other groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records, voices
from ..sources.derived import EVENTS_SQL, read, words
from .voices import _SQL as VOICES_SQL
from .voices import _profiles, _trials, _truth

SEGMENT_US, OFFSET_US, GROUP = 40_000_000, 5_000_000, 100
FAR_TARGETS = (0.0, 0.1)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a channel by stretches of time, with a text that shows whether it was rebuilt."""
    rows = words(spark, sf_dir).withColumn("segment", F.floor(F.col("start_us") / SEGMENT_US))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("start_us").alias("start"), "seq", F.col("end_us").alias("end"), "text")))
    made = rows.groupBy("channel", "segment").agg(ordered.alias("words"))
    return made.select("channel", "segment", F.array_join("words.text", "_").alias("text"), F.col("words")[0]["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), "words")


def prj01_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01: segments and their words moved by five seconds."""
    moved = records.shifted(_segments(spark, sf_dir), F.lit(OFFSET_US))
    total = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + w["start"] + w["end"])
    return moved.select("channel", "segment", "start", "end", total.alias("word_times"))


def prj02_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02: segments without the words whose middle lies before the middle of the stretch."""
    kept = records.clipped(_segments(spark, sf_dir), F.col("segment") * SEGMENT_US + SEGMENT_US // 2)
    return kept.select("channel", "segment", "text", "start", "end", F.size("words").cast("long").alias("n_words"))


def fn16_name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-16: customers' names and their parts."""
    name = F.regexp_replace("c_name", "#", " ")
    return read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(T.name_forms(name)).alias("place", "form"))


def fn25_token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-25: the reward at each token of the benchmark's texts, as phrases."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "token"))
    return rows.select("item_id", (F.col("place") + 1).alias("depth"), F.round(T.token_score(F.col("place") + 1), 6).alias("score"))


def ev19_cross_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-19: false alarms of galleries of other groups at the thresholds of the own group with the best detection at a false alarm rate."""
    place = F.when(F.col("trial") < 0, -F.col("trial") - 1).otherwise(F.col("trial"))
    trials = _trials(spark, sf_dir).withColumn("group", F.floor(place / GROUP))
    profiles = _profiles(spark, sf_dir).withColumn("group", F.expr(f"profile div {GROUP}"))
    own = trials.join(profiles, ["model", "group"]).select("trial", "profile", voices.dot("v", "p").alias("score"))
    curve = voices.curve(own, _truth(spark, sf_dir))
    targets = F.explode(F.array(*[F.lit(t) for t in FAR_TARGETS])).alias("target")
    best = F.min_by("score", F.struct(-F.col("dir"), "score"))
    points = curve.select("score", "dir", "far", targets).where("far <= target").groupBy("target").agg(best.alias("threshold"))
    top = voices.best_match(voices.highest_scores(trials, profiles, apart=True), -2.0).where("score is not null").select(F.round("score", 4).alias("score"))
    return F.broadcast(points).join(top).groupBy("target", "threshold").agg(F.round(F.avg((F.col("score") >= F.col("threshold")).cast("double")), 6).alias("cross_far"))


_SEGMENTS = f"WITH {EVENTS_SQL}, s AS (SELECT *, start_us // {SEGMENT_US} AS segment FROM words)"
QUERIES = {f.__name__: f for f in (prj01_shifted, prj02_clipped, fn16_name_forms, fn25_token_scores, ev19_cross_groups)}
ORACLE_SQL = {
    "prj01_shifted": _SEGMENTS + f""" SELECT channel, segment, min(start_us) + {OFFSET_US} AS start, max(end_us) + {OFFSET_US} AS "end", CAST(sum(start_us + end_us + {2 * OFFSET_US}) AS BIGINT) AS word_times FROM s GROUP BY channel, segment""",
    "prj02_clipped": _SEGMENTS + f""", k AS (SELECT *, mid_us >= segment * {SEGMENT_US} + {SEGMENT_US // 2} AS kept FROM s)
SELECT channel, segment, CASE WHEN bool_and(kept) THEN string_agg(text, '_' ORDER BY start_us, seq) ELSE string_agg(text, ' ' ORDER BY start_us, seq) FILTER (kept) END AS text,
min(start_us) FILTER (kept) AS start, max(end_us) FILTER (kept) AS "end", count(*) FILTER (kept) AS n_words FROM k GROUP BY channel, segment HAVING bool_or(kept)""",
    "fn16_name_forms": """WITH n AS (SELECT c_custkey, replace(c_name, '#', ' ') AS name FROM customer), f AS (SELECT c_custkey, name, list_filter(string_split_regex(name, '\\s+'), lambda p: p <> '') AS parts FROM n),
g AS (SELECT c_custkey, CASE WHEN len(parts) > 1 THEN list_prepend(name, parts) ELSE [name] END AS forms FROM f) SELECT c_custkey, generate_subscripts(forms, 1) - 1 AS place, unnest(forms) AS form FROM g""",
    "fn25_token_scores": """WITH t AS (SELECT item_id, generate_subscripts(string_split(text, ' '), 1) AS depth FROM benchmark)
SELECT item_id, CAST(depth AS INT) AS depth, round(CASE WHEN depth <= 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE + ln(depth) END, 6) AS score FROM t""",
    "ev19_cross_groups": VOICES_SQL + f""", p AS (SELECT *, CASE WHEN trial < 0 THEN -trial - 1 ELSE trial END // {GROUP} = profile // {GROUP} AS own FROM scored),
b AS (SELECT trial, own, arg_min(profile, (-score, profile)) AS profile, round(max(score), 4) AS score FROM p GROUP BY trial, own),
c AS (SELECT score, count(*) FILTER (trial >= 0 AND profile = trial) AS rgt, count(*) FILTER (trial < 0) AS st FROM b WHERE own GROUP BY score),
n AS (SELECT count(*) FILTER (trial >= 0) AS ak, count(*) FILTER (trial < 0) AS ast FROM b WHERE own),
r AS (SELECT score, round(sum(rgt) OVER o / ak, 6) AS dir, round(sum(st) OVER o / ast, 6) AS far FROM c, n WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT target, arg_min(score, (-dir, score)) AS threshold FROM r, (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) v(target) WHERE far <= target GROUP BY target)
SELECT target, threshold, round(avg(CAST(b.score >= threshold AS INT)), 6) AS cross_far FROM t, b WHERE NOT own GROUP BY target, threshold""",
}
