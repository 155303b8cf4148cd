"""Queries on clusters, phrases, signals, changing galleries and annotation files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, signals, terms, updates, voices
from ..sources import annotations
from ..sources.derived import EVENTS_SQL, read, turns, vectors, words
from ..streaming.speech import shared_folder

POLICIES = [
    updates.Policy("never"), updates.Policy("always", 0.0), updates.Policy("margin", 0.1), updates.Policy("wide margin", 0.2),
    updates.Policy("margin and clean", 0.1, 5.0), updates.Policy("only right ones", 0.0, 0.0, True),
]


def _grouped(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    return vectors(spark, sf_dir).select(F.expr(f"vec_id div {each}").alias("key"), F.col("vec_id").alias("seq"), voices.unit("v").alias("v"))


def cl01_linkages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL-01: four clusters of every twenty vectors by each of the four linkages, and as many as complete linkage finds below a distance."""
    rows = _grouped(spark, sf_dir, 20)
    parts = [clusters.clustered_by(rows, m, count=4).withColumn("method", F.lit(m)) for m in clusters.LINKAGES]
    parts.append(clusters.clustered_by(rows, "complete", threshold=0.8).withColumn("method", F.lit("below 0.8")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cl02_spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL-02: spectral clusters of every fifty vectors, four of them and as many as the eigengap says."""
    rows = _grouped(spark, sf_dir, 50)
    four = clusters.clustered_by(rows, "spectral", count=4)
    return four.join(clusters.clustered_by(rows, "spectral").withColumnRenamed("cluster", "found"), ["key", "seq"])


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two, the first three, and the second to fourth words of each benchmark item, some of which begin or end others."""
    ws = read(spark, sf_dir, "benchmark").select(terms.words_of(F.col("text")).alias("ws"))
    return ws.select(F.explode(F.array(*[F.array_join(F.slice("ws", at, n), " ") for at, n in ((1, 2), (1, 3), (2, 3), (3, 1))])).alias("phrase"))


def cl05_phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL-05: occurrences of phrases of the benchmark in every document, by one automaton."""
    return terms.phrase_hits(read(spark, sf_dir, "documents"), _phrases(spark, sf_dir), "doc_id")


def cl05_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL-05 and FN-25: the rewards that a decoder biased to these phrases would gain along every conversation turn."""
    said = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "text")
    found = [r[0] for r in _phrases(spark, sf_dir).distinct().limit(terms.MOST_PHRASES).collect()]
    return terms.boosts(said, found, "place").withColumn("boost", F.round("boost", 6))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors after another as one stream of samples."""
    rows = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("stream"), (F.col("vec_id") % 50 * 64).alias("at"), F.posexplode("embedding").alias("i", "x"))
    return rows.select("stream", (F.col("at") + F.col("i")).alias("place"), F.floor(F.col("x").cast("double") * 30000).cast("long").alias("sample"))


def ev23_sample_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-23: the lag of a delayed and disturbed copy of each stream, over its loudest 25 ticks."""
    far = _track(spark, sf_dir).withColumnRenamed("sample", "far")
    late = far.select("stream", (F.col("place") + F.col("stream") % 9).alias("place"), F.col("far").alias("late"))
    both = far.join(late, ["stream", "place"], "left").withColumn("near", F.coalesce("late", F.lit(0)) + F.col("place") * 37 % 101 - 50)
    found = signals.sample_lag(both.select("stream", "place", F.col("near").cast("double").alias("near"), F.col("far").cast("double").alias("far")), 12, 1600, 64)
    return found.select("stream", "lag", F.round(F.col("product") / 1e6, 3).alias("product"))


def tr04_reference_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TR-04: windows of 80 samples of a track that begins at place 100, from before its start to beyond its end."""
    track = _track(spark, sf_dir).withColumn("place", F.col("place") + 100)
    asks = vectors(spark, sf_dir).select(F.expr("vec_id div 50").alias("stream"), F.col("vec_id").alias("ask"), (F.col("vec_id") % 50 * 83 - 160).alias("place"), F.lit(80).alias("count"))
    made = signals.reference_windows(track, asks)
    return made.select("stream", "ask", F.col("samples").isNotNull().alias("arrived"), F.when(F.col("samples").isNotNull(), F.size("samples")).alias("n"), F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def ag18_echo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-18: by how much an output of a quarter or a tenth of the input is quieter, in ticks of eight samples in which the other vector of a pair is loud."""
    rows = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("stream"), (F.col("vec_id") % 2).alias("side"), F.posexplode("embedding").alias("place", "x")).withColumn("x", F.col("x").cast("double"))
    pairs = rows.groupBy("stream", "place").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("mic"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("far"))
    heard = pairs.withColumn("out", F.col("mic") * F.when(F.col("place") % 2 == 1, 0.25).otherwise(0.1))
    return signals.echo_loss(heard, 8, -20.0).withColumn("loss_db", F.round("loss_db", 5))


def jn15_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15: clusters of every sixth turn spread to all turns of a channel, by shared time, else by the nearest mean vector."""
    t = turns(spark, sf_dir)
    n = read(spark, sf_dir, "embeddings").count()
    spans = t.select(F.col("channel").alias("key"), F.col("seq").alias("unit"), F.col("start_us").alias("start"), F.col("end_us").alias("end"))
    seeds = t.where("seq % 6 = 0").select(F.col("channel").alias("key"), F.col("seq").alias("unit"), (F.col("seq") % 4).alias("cluster"))
    own = t.select(F.col("channel").alias("key"), F.col("seq").alias("unit"), F.expr(f"seq div 2 % {max(n, 1)}").alias("vec_id"))
    return updates.propagated(spans, seeds, own.join(vectors(spark, sf_dir), "vec_id").select("key", "unit", "v"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.concat(F.lit("p"), F.col("label")).alias("true_name"))
    return rows.withColumn("v", voices.unit("v")).withColumn("group", F.col("vec_id") % 4)


def ag24_update_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-24: what each policy would have added to the galleries of four groups, meeting by meeting; a gallery starts with each person's first vector."""
    rows = _labelled(spark, sf_dir)
    firsts = rows.groupBy("group", "true_name").agg(F.min("vec_id").alias("vec_id"))
    gallery = rows.join(firsts.select("vec_id"), "vec_id").select("group", F.col("true_name").alias("name"), "v")
    heard = rows.join(firsts.select("vec_id"), "vec_id", "left_anti").select("group", F.expr("vec_id div 40").alias("meeting"), F.col("vec_id").alias("seq"), "v", (F.col("vec_id") % 11).cast("double").alias("clean"), "true_name")
    return updates.policy_summary(updates.replayed(heard, gallery, POLICIES, 0.2))


def ev18_fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-18: the merges of a fold of every twenty vectors, and whether each joins vectors of one person."""
    rows = _labelled(spark, sf_dir).select(F.expr("vec_id div 20").alias("key"), F.format_string("c%08d", "vec_id").alias("label"), "v", (F.col("vec_id") % 7 + 1).cast("double").alias("seconds"), "true_name")
    return updates.fold_steps(rows, 0.15).withColumn("score", F.round("score", 6))


def _written(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}_{uuid.uuid4().hex[:12]}"


def src14_annotated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: words written as annotation XML and read back; punctuation, words without times and those without length are left out."""
    made = words(spark, sf_dir).select(
        (F.col("channel") % 10).alias("meeting"), F.col("channel").alias("agent"), F.col("seq").alias("id"), F.when(F.col("seq") % 13 != 1, F.col("start_us") / 1e6).alias("start"),
        F.when(F.col("seq") % 17 == 1, F.col("start_us") / 1e6).otherwise(F.col("end_us") / 1e6).alias("end"), (F.col("seq") % 11 == 1).alias("punc"), "text",
    )
    path = _written(spark, "src14")
    annotations.write_words(made, path)
    return annotations.annotated_words(spark, path)


def src09_voiceprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: vectors written as one map per meeting and read back."""
    path = _written(spark, "src09")
    annotations.write_voiceprints(vectors(spark, sf_dir).select(F.expr("vec_id div 10").alias("meeting"), F.lit("m").alias("model"), F.concat(F.lit("S"), F.col("vec_id") % 10).alias("label"), F.col("v").alias("vector")), path)
    back = annotations.voiceprints(spark, path)
    return back.select("meeting", "label", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def src15_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15: the types of each user's events as scores of a trial, written and read back."""
    path = _written(spark, "src15")
    rows = read(spark, sf_dir, "events").groupBy(F.concat(F.lit("t"), F.col("user_id")).alias("name"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("u"), F.col("user_id") % 3)).alias("true_speaker"), F.col("event_type").alias("profile")).agg(F.max("value").alias("score"))
    annotations.write_trials(rows, path)
    return annotations.trials(spark, path)


QUERIES = {f.__name__: f for f in (
    cl01_linkages, cl02_spectral, cl05_phrase_hits, cl05_boosts, ev23_sample_lag, tr04_reference_windows, ag18_echo_loss, jn15_propagated, ag24_update_policies, ev18_fold_audit,
    src14_annotated_words, src09_voiceprints, src15_trials,
)}
_TRACK = "track AS (SELECT vec_id // 50 AS stream, vec_id % 50 * 64 + generate_subscripts(embedding, 1) - 1 AS place, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 30000) AS BIGINT) AS sample FROM embeddings)"
ORACLE_SQL = {
    "cl05_phrase_hits": """WITH b AS (SELECT list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM benchmark),
p AS (SELECT DISTINCT unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[1:3], ' '), array_to_string(ws[2:4], ' '), array_to_string(ws[3:3], ' ')]) AS phrase FROM b),
d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS k(n)))
SELECT doc_id, phrase, count(*) AS hits FROM g JOIN p USING (phrase) WHERE phrase <> '' GROUP BY doc_id, phrase""",
    "ev23_sample_lag": f"""WITH {_TRACK}, s AS (SELECT t.stream, t.place, t.sample AS far, coalesce(l.sample, 0) + t.place * 37 % 101 - 50 AS near FROM track t LEFT JOIN track l ON l.stream = t.stream AND l.place = t.place - t.stream % 9),
lv AS (SELECT stream, place // 64 AS tick, sqrt(avg(far * far)) AS level FROM s GROUP BY ALL),
w AS (SELECT stream, tick, round(sum(level) OVER o, 6) AS total, count(*) OVER o AS n FROM lv WINDOW o AS (PARTITION BY stream ORDER BY tick ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING)),
st AS (SELECT stream, arg_min(tick, (-total, tick)) * 64 AS start FROM w WHERE n = 25 GROUP BY stream),
c AS (SELECT s.stream, place, near - avg(near) OVER (PARTITION BY s.stream) AS near, far - avg(far) OVER (PARTITION BY s.stream) AS far FROM s JOIN st ON s.stream = st.stream AND place >= start AND place < start + 1600),
x AS (SELECT a.stream, lag, sum(a.near * b.far) AS product FROM (SELECT *, unnest(range(-12, 13)) AS lag FROM c) a JOIN c b ON b.stream = a.stream AND b.place = a.place - a.lag GROUP BY a.stream, lag)
SELECT stream, arg_min(lag, (-round(abs(product), 3), lag)) AS lag, round(arg_min(product, (-round(abs(product), 3), lag)) / 1e6, 3) AS product FROM x GROUP BY stream""",
    "tr04_reference_windows": f"""WITH {_TRACK}, t AS (SELECT stream, place + 100 AS place, sample FROM track), b AS (SELECT stream, max(place) AS last FROM t GROUP BY stream),
a AS (SELECT vec_id // 50 AS stream, vec_id AS ask, vec_id % 50 * 83 - 160 AS place FROM embeddings)
SELECT a.stream, ask, last IS NOT NULL AND (a.place + 80 <= 100 OR a.place + 79 <= last) AS arrived, CASE WHEN arrived THEN 80 END AS n, CASE WHEN arrived THEN CAST(coalesce(sum(sample), 0) AS BIGINT) END AS total
FROM a LEFT JOIN b USING (stream) LEFT JOIN t ON t.stream = a.stream AND t.place >= a.place AND t.place < a.place + 80 GROUP BY a.stream, ask, a.place, last""",
    "ag18_echo_loss": """WITH x AS (SELECT vec_id // 2 AS stream, vec_id % 2 AS side, generate_subscripts(embedding, 1) - 1 AS place, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT stream, place, max(x) FILTER (side = 0) AS mic, max(x) FILTER (side = 1) AS far FROM x GROUP BY stream, place),
t AS (SELECT stream, place // 8 AS tick, avg(mic * mic) AS mic, avg(power(mic * CASE WHEN place % 2 = 1 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END, 2)) AS o, avg(far * far) AS far FROM p GROUP BY ALL)
SELECT stream, count(*) AS active, round(10 * log10(avg(mic)) - 10 * log10(avg(o)), 5) AS loss_db FROM t WHERE 10 * log10(greatest(far, 1e-10)) > -20 GROUP BY stream""",
    "jn15_propagated": f"""WITH {EVENTS_SQL}, n AS (SELECT count(*) AS n FROM embeddings),
u AS (SELECT t.*, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM turns t, n JOIN embeddings e ON e.vec_id = t.seq // 2 % n.n),
sd AS (SELECT channel, seq, seq % 4 AS cluster, start_us, end_us, v FROM u WHERE seq % 6 = 0),
mx AS (SELECT *, max(end_us) OVER (PARTITION BY channel, cluster ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sd),
mg AS (SELECT *, sum(CASE WHEN before IS NULL OR start_us > before THEN 1 ELSE 0 END) OVER (PARTITION BY channel, cluster ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM mx),
sp AS (SELECT channel, cluster, min(start_us) AS s, max(end_us) AS e FROM mg GROUP BY channel, cluster, g),
sh AS (SELECT u.channel, u.seq, cluster, sum(least(end_us, e) - greatest(start_us, s)) AS shared FROM u JOIN sp ON sp.channel = u.channel AND start_us < e AND s < end_us WHERE u.seq % 6 <> 0 GROUP BY ALL),
bt AS (SELECT channel, seq, arg_min(cluster, (-shared, cluster)) AS cluster FROM sh GROUP BY channel, seq),
cc AS (SELECT channel, cluster, i, avg(x) AS x FROM (SELECT channel, cluster, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM sd) GROUP BY ALL), ce AS (SELECT channel, cluster, list(x ORDER BY i) AS c FROM cc GROUP BY ALL),
al AS (SELECT u.channel, u.seq, cluster, round(list_dot_product(v, c), 9) AS s FROM u JOIN ce ON ce.channel = u.channel WHERE u.seq % 6 <> 0 AND (u.channel, u.seq) NOT IN (SELECT channel, seq FROM bt)),
bv AS (SELECT channel, seq, arg_min(cluster, (-s, cluster)) AS cluster FROM al GROUP BY channel, seq)
SELECT u.channel AS key, u.seq AS unit, coalesce(sd.cluster, bt.cluster, bv.cluster) AS cluster FROM u LEFT JOIN sd USING (channel, seq) LEFT JOIN bt USING (channel, seq) LEFT JOIN bv USING (channel, seq)""",
    "src14_annotated_words": f"""WITH {EVENTS_SQL} SELECT CAST(channel % 10 AS VARCHAR) AS meeting, CAST(channel AS VARCHAR) AS agent, CAST(seq AS VARCHAR) AS id, start_us / 1e6 AS start, end_us / 1e6 AS "end", text
FROM words WHERE seq % 11 <> 1 AND seq % 13 <> 1 AND seq % 17 <> 1""",
    "src09_voiceprints": "SELECT CAST(vec_id // 10 AS VARCHAR) AS meeting, 'S' || vec_id % 10 AS label, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "src15_trials": "SELECT 't' || user_id AS name, CASE WHEN user_id % 3 > 0 THEN 'u' || user_id % 3 END AS true_speaker, event_type AS profile, max(value) AS score FROM events GROUP BY ALL",
}
