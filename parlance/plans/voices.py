"""Queries on voice embeddings. The query set is every vector whose id is divisible by 20; all others are profiles. Every other trial is known: it mixes its vector with the next, whose profile is meant; the rest are strangers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import voices
from ..sources.derived import vectors


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("vec_id % 20 <> 0").select(F.lit("m").alias("model"), F.col("vec_id").alias("profile"), voices.unit("v").alias("p"))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A known trial has the id of its profile, a stranger a negative one."""
    rows = vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0")
    meant = rows.where("vec_id % 20 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("o"))
    mixed = asked.where("vec_id % 40 = 0").join(meant, "vec_id").select((F.col("vec_id") + 1).alias("trial"), F.zip_with("o", "v", lambda x, y: 0.8 * x + 0.6 * y).alias("v"))
    both = mixed.unionByName(asked.where("vec_id % 40 <> 0").select((-F.col("vec_id") - 1).alias("trial"), "v"))
    return both.select(F.lit("m").alias("model"), "trial", voices.unit("v").alias("v"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trials(spark, sf_dir).select("trial", F.when(F.col("trial") >= 0, F.col("trial")).alias("true_profile"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores among which each trial's best is."""
    return voices.highest_scores(_trials(spark, sf_dir), _profiles(spark, sf_dir))


def jn07_best_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-07 and FN-23: the profile of each trial at threshold 0.56."""
    return voices.best_match(_scored(spark, sf_dir)).withColumn("score", F.round("score", 6))


def so06_strangers_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-06: strangers whose best score is above a floor, highest first."""
    strangers = voices.highest_scores(_trials(spark, sf_dir).where("trial < 0"), _profiles(spark, sf_dir))
    top = voices.best_match(strangers, -2.0).withColumn("score", F.round("score", 6))
    return top.where("score > 0.3").orderBy(F.desc("score"), "trial")


def ag02_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-02: per label the unit vector of the weighted sum, as its first coordinate and its length."""
    rows = _labelled(spark, sf_dir)
    mean = voices.weighted_mean(rows, ["label"], "v", "seconds")
    return mean.select("label", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(voices.dot("v", "v"), 5).alias("length2"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 7 + 1).cast("double").alias("seconds"))


def ag07_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-07: per trial the profile with the greatest mean cosine, of profiles of up to eight vectors each."""
    wide = _profiles(spark, sf_dir).withColumn("profile", F.expr("profile div 8"))
    # Of means that are equal when rounded, the first profile counts.
    mean = voices.highest_scores(_trials(spark, sf_dir), voices.mean_profiles(wide), within=2e-6)
    return voices.best_match(mean.withColumn("score", F.round("score", 6)), -2.0)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of four clusters: a vector, its two mixtures with the next, and the next."""
    rows = vectors(spark, sf_dir).select(F.expr("vec_id div 2").alias("channel"), (F.col("vec_id") % 2).alias("k"), "v")
    base = rows.where("k = 0").select("channel", F.col("v").alias("b"))
    other = rows.where("k = 1").select("channel", F.col("v").alias("o"))
    both = base.join(other, "channel")
    mixes = F.array(*[F.struct(F.lit(f"S{i}").alias("label"), F.lit(float(s)).alias("seconds"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (s, x, y) in enumerate(((30, 1.0, 0.0), (20, 0.9, 0.3), (5, 0.6, 0.7), (9, 0.0, 1.0)))])
    mixed = both.select("channel", "b", "o", F.explode(mixes).alias("m"))
    v = F.zip_with("b", "o", lambda p, q: p * F.col("m.x") + q * F.col("m.y"))
    return mixed.select("channel", "m.label", "m.seconds", voices.unit(v).alias("v"))


def ag08_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-08: whether a channel's clusters are one speaker."""
    near = _clusters(spark, sf_dir).where("label <> 'S3' or channel % 2 = 0")
    return voices.collapse(near).withColumn("least", F.round("least", 6))


def ag09_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-09 and CL-06: clusters folded to two a channel."""
    return voices.fold(_clusters(spark, sf_dir), 2)


def ag14_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14: detection, false alarm and false reject rates at 0.56."""
    return voices.rates(_scored(spark, sf_dir), _truth(spark, sf_dir), voices.ACCEPT)


def ag15_threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-15: the rates at every top score."""
    return voices.curve(_scored(spark, sf_dir), _truth(spark, sf_dir))


def jn09_cross_group_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09: trials against profiles of the same and of other groups of 200 ids: how many, and their mean score."""
    known = _trials(spark, sf_dir).where("trial >= 0").withColumn("group", F.expr("trial div 200"))
    means = voices.group_means(known, _profiles(spark, sf_dir).withColumn("group", F.expr("profile div 200")))
    return means.withColumn("mean_score", F.round("mean_score", 5))


def so05_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-05: of each label's vectors all but the newest eight; undated ones go first, then by date, then by index."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 11).alias("day"))
    newest = W.partitionBy("label").orderBy(F.col("day").desc_nulls_last(), F.desc("vec_id"))
    return rows.withColumn("place", F.row_number().over(newest)).where("place > 8").select("vec_id", "label")


_SQL = """WITH vs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
profiles AS (SELECT vec_id AS profile, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS p FROM vs WHERE vec_id % 20 <> 0),
raw AS (SELECT b.vec_id AS trial, list_transform(list_zip(b.v, a.v), lambda z: 0.8 * z[1] + 0.6 * z[2]) AS v FROM vs a JOIN vs b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 40 = 0
UNION ALL SELECT -vec_id - 1, v FROM vs WHERE vec_id % 40 = 20),
trials AS (SELECT trial, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM raw),
scored AS (SELECT trial, profile, list_dot_product(v, p) AS score FROM trials, profiles),
best AS (SELECT trial, arg_min(profile, (-score, profile)) AS profile, max(score) AS score FROM scored GROUP BY trial)"""
QUERIES = {f.__name__: f for f in (
    jn07_best_profile, so06_strangers_above, ag02_weighted_mean, ag07_mean_score, ag08_collapse, ag09_fold, ag14_rates, ag15_threshold_curve, jn09_cross_group_trials, so05_evict,
)}
ORACLE_SQL = {
    "jn07_best_profile": _SQL + " SELECT trial, CASE WHEN score >= 0.56 THEN profile END AS profile, round(score, 6) AS score FROM best",
    "so06_strangers_above": _SQL + " SELECT trial, profile, round(score, 6) AS score FROM best WHERE trial < 0 AND round(score, 6) > 0.3",
    "ag02_weighted_mean": """WITH e AS (SELECT CAST(label AS VARCHAR) AS label, CAST(vec_id % 7 + 1 AS DOUBLE) AS s, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, sum(x * s) AS x FROM e GROUP BY label, i) SELECT label, round(max(x) FILTER (i = 1) / sqrt(sum(x * x)), 5) AS first, 1.0::DOUBLE AS length2 FROM m GROUP BY label""",
    "ag07_mean_score": _SQL + ", m AS (SELECT trial, profile // 8 AS profile, round(avg(score), 6) AS score FROM scored GROUP BY ALL) SELECT trial, arg_min(profile, (-score, profile)) AS profile, max(score) AS score FROM m GROUP BY trial",
    "ag08_collapse": """WITH nv AS (SELECT vec_id // 2 AS channel, vec_id % 2 AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
mix(label, x, y) AS (VALUES ('S0', 1.0::DOUBLE, 0.0::DOUBLE), ('S1', 0.9, 0.3), ('S2', 0.6, 0.7), ('S3', 0.0, 1.0)),
m AS (SELECT a.channel, label, list_transform(list_zip(a.v, b.v), lambda z: z[1] * x + z[2] * y) AS v FROM nv a JOIN nv b ON a.channel = b.channel AND a.k = 0 AND b.k = 1, mix),
c AS (SELECT channel, label, list_transform(v, lambda q: q / sqrt(list_dot_product(v, v))) AS v FROM m WHERE label <> 'S3' OR channel % 2 = 0),
p AS (SELECT a.channel, min(list_dot_product(a.v, b.v)) AS least FROM c a JOIN c b ON a.channel = b.channel AND a.label < b.label GROUP BY a.channel),
n AS (SELECT channel, count(*) AS n FROM c GROUP BY channel)
SELECT channel, n, round(least, 6) AS least, n >= 2 AND coalesce(least, -1) >= 0.6 AS collapse FROM n LEFT JOIN p USING (channel)""",
    "ag14_rates": _SQL + """ SELECT round(avg(CASE WHEN trial >= 0 THEN CAST(score >= 0.56 AND profile = trial AS INT) END), 6) AS dir,
round(avg(CASE WHEN trial < 0 THEN CAST(score >= 0.56 AS INT) END), 6) AS far, round(avg(CASE WHEN trial >= 0 THEN CAST(score < 0.56 AS INT) END), 6) AS frr FROM best""",
    "ag15_threshold_curve": _SQL + """, r AS (SELECT round(score, 4) AS score, count(*) FILTER (trial >= 0 AND profile = trial) AS rgt, count(*) FILTER (trial >= 0) AS known, count(*) FILTER (trial < 0) AS strangers FROM best GROUP BY 1),
t AS (SELECT sum(known) AS ak, sum(strangers) AS ast FROM r)
SELECT score, round(sum(rgt) OVER o / ak, 6) AS dir, round(sum(strangers) OVER o / ast, 6) AS far, round(1 - sum(known) OVER o / ak, 6) AS frr FROM r, t WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""",
    "jn09_cross_group_trials": _SQL + " SELECT trial // 200 = profile // 200 AS same_group, count(*) AS n, round(avg(score), 5) AS mean_score FROM scored WHERE trial >= 0 GROUP BY 1",
    "so05_evict": """SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 3 > 0 THEN vec_id % 11 END DESC NULLS LAST, vec_id DESC) AS place FROM embeddings) WHERE place > 8""",
}
