"""Queries on samples, tokens, stores and judgements derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, voices
from ..sources import transcripts
from ..sources.derived import EVENTS_SQL, entries, read, vectors, words
from .texts import ORACLE_SQL as TEXTS


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("stream"), (F.col("vec_id") % 2).alias("channel"), F.posexplode("embedding").alias("frame", "x"))
    return rows.select("stream", "channel", F.col("frame").cast("long").alias("frame"), F.floor(F.col("x").cast("double") * 30000).cast("long").alias("sample"))


def src03_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: pairs of vectors as two channels, mixed to mono by a truncated mean."""
    return records.downmix(_samples(spark, sf_dir)).select("stream", "frame", "sample")


def src02_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02: vectors as interleaved two-channel samples: sums per channel."""
    blocks = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stream"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 30000)).alias("samples"))
    return records.deinterleave(blocks, 2).groupBy("stream", "channel").agg(F.sum("sample").alias("total"), F.count(F.lit(1)).alias("n"))


def st14_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-14: ten vectors as channels of one stream, summed and kept within 16 bits."""
    rows = _samples(spark, sf_dir).select(F.expr("stream div 5").alias("stream"), F.col("frame").alias("place"), (F.col("sample") * 3).alias("sample"))
    return records.mix(rows)


def prj05_sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-05: samples of word starts."""
    return words(spark, sf_dir).select("seq", records.sample_index(F.col("start_us") / 1000000.0).alias("sample"))


def prj06_pcm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-06: samples to float and back."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 30000).cast("short")).alias("s"))
    back = rows.select("vec_id", "s", records.to_int16(records.to_float(F.col("s"))).alias("b"))
    return back.select("vec_id", (F.col("s") == F.col("b")).alias("same"))


def jn13_paired_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13: near frames with far ones, silence where they miss."""
    rows = _samples(spark, sf_dir)
    near = rows.where("channel = 0").select("stream", F.col("frame").alias("tick"), F.col("sample").alias("near"))
    far = rows.where("channel = 1 and frame % 3 <> 0").select("stream", F.col("frame").alias("tick"), F.col("sample").alias("far"))
    return records.paired_frames(far, near)


def wn23_best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-23: the lag of vectors against themselves moved by three places."""
    rows = _samples(spark, sf_dir).where("channel = 0").select("stream", F.col("frame").alias("tick"), F.col("sample").cast("double").alias("near"))
    moved = rows.select("stream", (F.col("tick") - 3).alias("tick"), F.col("near").alias("far"))
    return records.best_lag(rows.join(moved, ["stream", "tick"]), 5)


def wn07_merge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-07 and AG-06: pieces of three characters of benchmark items merged to words, with the weakest confidence."""
    pieces = F.regexp_extract_all("text", F.lit("( ?[^ ]{1,3})"), 1)
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.posexplode(pieces).alias("seq", "text"))
    timed = rows.withColumn("start_us", F.col("seq") * 100).withColumn("end_us", F.col("seq") * 100 + 80).withColumn("confidence", (F.col("seq") % 7) / 8.0)
    return records.merged_tokens(timed).withColumn("word", F.col("word").cast("long"))


def wn09_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-09: benchmark items cut to sentences."""
    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.posexplode(F.split("text", " ")).alias("seq", "text"))
    return records.sentences(rows).withColumn("sentence", F.col("sentence").cast("long"))


def wn06_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-06 and SM-11 without its timer: caption lines of each channel."""
    return records.caption_lines(words(spark, sf_dir)).groupBy("channel", "part", "line").agg(F.count(F.lit(1)).alias("n_words"))


def mu01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MU-01: a store of labels with ten more vectors each, capped at eight."""
    rows = _store(spark, sf_dir)
    return _told(records.upserted(rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1")))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 5)
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("name"), F.lit("m").alias("model"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vector"), date.alias("date"))


def _told(store: DataFrame) -> DataFrame:
    return store.select("name", "idx", "date", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("vector"))


def mu01_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MU-01: a store in which profile 1 is renamed to 2, which there is already, and profile 3 removed."""
    return _told(records.removed(records.renamed(_store(spark, sf_dir), "1", "2"), "3"))


def mu02_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MU-02: each meeting as Markdown again after the label user got a name."""
    return transcripts.markdown(records.assigned(entries(spark, sf_dir).withColumn("provisional", F.col("seq") % 5 == 0), "user", "Ada"))


def mu02_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MU-02: entries with the label user given a name."""
    return records.assigned(entries(spark, sf_dir), "user", "Ada").groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))


def prj10_visible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10: event types with words."""
    types = read(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()
    spoken = words(spark, sf_dir).select(F.col("text").alias("label")).distinct()
    return types.join(spoken, "label", "left_semi")


def cl01_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL-01: average-link clusters of tens of unit vectors; as many as there are vectors when none are alike."""
    rows = vectors(spark, sf_dir).select(F.expr("vec_id div 20").alias("key"), F.col("vec_id").alias("seq"), voices.unit("v").alias("v"))
    return records.clustered(rows, 0.2)


def ev03_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-03: wins per model from turns as judgements."""
    rows = read(spark, sf_dir, "conversations").select(
        F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))).alias("models"), F.when(F.col("turn") % 4 > 0, F.col("turn") % 3 - 1).alias("pick"),
        F.when(F.col("conv_id") % 2 == 0, "de").otherwise("en").alias("language"), F.col("role").alias("bucket"),
    )
    return records.wins(rows)


def ev26_count_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-26: a speaker-count hint per conversation: null under two roles, eight at most."""
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("n"))
    return n.select("conv_id", F.when(F.col("n") >= 2, F.least(F.col("n"), F.lit(8))).alias("hint"))


def so08_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-08: a pinned subsample: the 25 conversation turns that come first by a fixed digest."""
    key = F.md5(F.concat_ws(":", F.lit("pin"), "conv_id", "turn"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("k")).orderBy("k").limit(25).select("conv_id", "turn")


_SAMPLES = "s AS (SELECT vec_id // 2 AS stream, vec_id % 2 AS channel, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS frame FROM embeddings), samples AS (SELECT stream, channel, frame, CAST(floor(CAST(x AS DOUBLE) * 30000) AS BIGINT) AS sample FROM s)"
QUERIES = {f.__name__: f for f in (
    src02_channels, src03_downmix, st14_mix, prj05_sample_index, prj06_pcm_round_trip, prj10_visible_labels, jn13_paired_frames, wn23_best_lag, wn07_merge_tokens, wn09_sentences, wn06_captions,
    mu01_upsert, mu01_renamed, mu02_assign, mu02_rendered, cl01_clusters, ev03_wins, ev26_count_hint, so08_subsample,
)}
_STORE = "store AS (SELECT CAST(label AS VARCHAR) AS name, vec_id, CASE WHEN vec_id % 3 > 0 THEN vec_id % 5 END AS date, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS vector FROM embeddings)"
ORACLE_SQL = {
    "wn06_captions": f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT *, CASE WHEN lag(end_us) OVER w IS NULL OR start_us - lag(end_us) OVER w > 1500000 THEN 1 ELSE 0 END AS op FROM words WINDOW w AS (PARTITION BY channel ORDER BY start_us, seq)),
p AS (SELECT channel, text, start_us, seq, sum(op) OVER (PARTITION BY channel ORDER BY start_us, seq ROWS UNBOUNDED PRECEDING) AS part FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY channel, part ORDER BY start_us, seq) AS i FROM p),
r AS (SELECT channel, part, i, 0 AS line, length(text) AS chars FROM n WHERE i = 1
  UNION ALL
  SELECT n.channel, n.part, n.i, CASE WHEN r.chars >= 250 THEN line + 1 ELSE line END, CASE WHEN r.chars >= 250 THEN length(n.text) ELSE r.chars + 1 + length(n.text) END FROM r JOIN n ON n.channel = r.channel AND n.part = r.part AND n.i = r.i + 1)
SELECT channel, CAST(part AS BIGINT) AS part, line, count(*) AS n_words FROM r GROUP BY channel, part, line""",
    "wn23_best_lag": f"""WITH {_SAMPLES}, a AS (SELECT stream, frame AS tick, CAST(sample AS DOUBLE) AS near FROM samples WHERE channel = 0), m AS (SELECT a.stream, a.tick, a.near, b.near AS far FROM a JOIN a b ON b.stream = a.stream AND b.tick = a.tick + 3),
x AS (SELECT m.stream, lag, coalesce(sum(m.near * f.far) / nullif(sqrt(sum(m.near * m.near) * sum(f.far * f.far)), 0), 0.0) AS score FROM m JOIN (SELECT stream, tick + lag AS tick, far, lag FROM (SELECT *, unnest(range(-5, 6)) AS lag FROM m)) f ON f.stream = m.stream AND f.tick = m.tick GROUP BY m.stream, lag)
SELECT stream, arg_min(lag, (-round(score, 9), lag)) AS lag, round(max(score), 6) AS score FROM x GROUP BY stream""",
    "src02_channels": "WITH s AS (SELECT vec_id AS stream, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 30000) AS BIGINT) AS sample FROM embeddings) SELECT stream, i % 2 AS channel, CAST(sum(sample) AS BIGINT) AS total, count(*) AS n FROM s GROUP BY stream, i % 2",
    "src03_downmix": f"WITH {_SAMPLES} SELECT stream, frame, CAST(trunc(CAST(sum(sample) AS DOUBLE) / count(*)) AS INT) AS sample FROM samples GROUP BY stream, frame",
    "st14_mix": f"""WITH {_SAMPLES}, m AS (SELECT stream // 5 AS stream, frame AS place, CAST(sum(sample * 3) AS BIGINT) AS v FROM samples GROUP BY stream // 5, frame), t AS (SELECT stream, max(abs(v)) AS top FROM m GROUP BY stream)
SELECT stream, place, CAST(trunc(v * CASE WHEN top > 32767 THEN 32767.0::DOUBLE / top ELSE 1.0::DOUBLE END) AS INT) AS sample FROM m JOIN t USING (stream)""",
    "prj05_sample_index": f"WITH {EVENTS_SQL} SELECT seq, CAST(trunc(start_us / 1000000.0::DOUBLE * 16000) AS BIGINT) AS sample FROM words",
    "prj06_pcm_round_trip": "SELECT vec_id, true AS same FROM embeddings",
    "prj10_visible_labels": "SELECT DISTINCT event_type AS label FROM events WHERE event_id % 2 = 1",
    "jn13_paired_frames": f"WITH {_SAMPLES} SELECT a.stream, a.frame AS tick, a.sample AS near, coalesce(b.sample, 0) AS far FROM samples a LEFT JOIN samples b ON a.stream = b.stream AND a.frame = b.frame AND b.channel = 1 AND b.frame % 3 <> 0 WHERE a.channel = 0",
    "wn07_merge_tokens": """WITH p AS (SELECT item_id AS key, regexp_extract_all(text, '( ?[^ ]{1,3})', 1) AS ps FROM benchmark), t AS (SELECT key, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS seq FROM p),
o AS (SELECT *, CASE WHEN lag(text) OVER w IS NULL OR starts_with(text, ' ') THEN 1 ELSE 0 END AS op FROM t WINDOW w AS (PARTITION BY key ORDER BY seq)), r AS (SELECT *, sum(op) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS word FROM o)
SELECT key, CAST(word AS BIGINT) AS word, string_agg(trim(text), '' ORDER BY seq) AS text, min(seq) * 100 AS start_us, max(seq) * 100 + 80 AS end_us, min(seq % 7) / 8.0::DOUBLE AS confidence FROM r GROUP BY key, word""",
    "wn09_sentences": """WITH t AS (SELECT item_id AS key, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) AS seq FROM benchmark),
e AS (SELECT *, CASE WHEN regexp_matches(lag(text) OVER (PARTITION BY key ORDER BY seq), '[.!?…]$') THEN 1 ELSE 0 END AS e FROM t), s AS (SELECT *, CAST(sum(e) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sentence FROM e)
SELECT key, sentence, string_agg(text, ' ' ORDER BY seq) AS text FROM s GROUP BY key, sentence""",
    "mu01_upsert": f"""WITH {_STORE}, r AS (SELECT *, vec_id % 2 AS new FROM store),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date DESC NULLS LAST, new DESC, vec_id DESC) AS n FROM r) SELECT name, row_number() OVER (PARTITION BY name ORDER BY new, vec_id) AS idx, date, vector FROM k WHERE n <= 8""",
    "mu01_renamed": f"""WITH {_STORE}, r AS (SELECT * REPLACE (CASE WHEN name = '1' THEN '2' ELSE name END AS name), CASE WHEN name = '1' THEN 1 ELSE 0 END AS new FROM store WHERE name <> '3'),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY date DESC NULLS LAST, new DESC, vec_id DESC) AS n FROM r) SELECT name, row_number() OVER (PARTITION BY name ORDER BY new, vec_id) AS idx, date, vector FROM k WHERE n <= 8""",
    "mu02_rendered": TEXTS["snk01_markdown"].replace("role AS speaker", "CASE WHEN role = 'user' THEN 'Ada' ELSE role END AS speaker"),
    "mu02_assign": "SELECT CASE WHEN role = 'user' THEN 'Ada' ELSE role END AS speaker, count(*) AS n FROM conversations GROUP BY 1",
    "ev03_wins": """WITH p AS (SELECT CASE WHEN turn % 4 > 0 THEN turn % 3 - 1 END AS pick, CASE WHEN conv_id % 2 = 0 THEN 'de' ELSE 'en' END AS language, role AS bucket FROM conversations), m(model, variant) AS (VALUES ('a', 0), ('b', 0), ('c', 1))
SELECT model, language, bucket, count(*) AS sites, count(*) FILTER (variant = pick) AS wins FROM p, m WHERE pick >= 0 GROUP BY model, language, bucket""",
    "ev26_count_hint": "SELECT conv_id, CASE WHEN count(DISTINCT role) >= 2 THEN least(count(DISTINCT role), 8) END AS hint FROM conversations GROUP BY conv_id",
    "so08_subsample": "SELECT conv_id, turn FROM conversations ORDER BY md5('pin:' || conv_id || ':' || turn) LIMIT 25",
}
