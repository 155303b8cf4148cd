"""Queries on meeting profiles, names, the naming of clusters, and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, matching, profiles, voices
from ..sources.derived import ENTRIES_SQL, EVENTS_SQL, entries, read, turns, vectors
from .scoring import _pairs
from .speech import _OWN
from .voices import _clusters

ALIKE = 0.6


def prj07_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-07: vectors scaled to length 1; every seventh is zeroed first and stays zero."""
    v = F.when(F.col("vec_id") % 7 == 0, F.transform("v", lambda x: x * 0.0)).otherwise(F.col("v"))
    rows = vectors(spark, sf_dir).select("vec_id", voices.unit(v).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(voices.dot("v", "v"), 6).alias("length2"))


def prj09_named_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09: entries with the names of the speakers that have one: customers by number for users, none for others."""
    rows = entries(spark, sf_dir).withColumn("speaker", F.when(F.col("speaker") == "user", F.concat(F.lit("user"), F.col("meeting").cast("string"))).otherwise(F.col("speaker")))
    names = read(spark, sf_dir, "customer").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("speaker"), F.col("c_name").alias("name"))
    return profiles.named(rows, names).select("meeting", "seq", "speaker")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meeting, local, remote, switch): counts 0 to 2 or unknown, never both 0."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting")).distinct()
    local = F.when(F.col("meeting") % 4 < 3, (F.col("meeting") % 4).cast("int"))
    remote = F.when(F.col("meeting") % 5 < 4, F.when((F.col("meeting") % 4 == 0) & (F.col("meeting") % 5 == 0), 1).otherwise((F.col("meeting") % 5).cast("int")))
    switch = F.when(F.col("meeting") % 7 == 0, F.lit(True))
    return rows.select("meeting", local.alias("local"), remote.alias("remote"), switch.alias("switch"))


def prj11_planned_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-11: the channels that a meeting records, and whether speakers are estimated, told apart, or one."""
    return profiles.planned_channels(_counts(spark, sf_dir).drop("switch"))


def prj13_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-13: mode of a meeting, and whether its speakers are told apart."""
    c = F.col
    return _counts(spark, sf_dir).select("meeting", profiles.mode(c("local"), c("remote")).alias("mode"), profiles.diarizes(c("local"), c("remote"), c("switch")).alias("diarizes"))


def jn08_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-08: clusters of a channel named one-to-one from two profiles, best score first."""
    gallery = vectors(spark, sf_dir).select(F.expr("vec_id div 2").alias("channel"), F.col("vec_id").alias("profile"), voices.unit("v").alias("p"))
    scored = _clusters(spark, sf_dir).join(gallery, "channel").select("channel", "label", "profile", F.round(voices.dot("v", "p"), 6).alias("score"))
    return profiles.assigned(scored, ["channel"], voices.ACCEPT)


def se07_self_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-07: clusters of a channel joined along pairs that are alike."""
    return profiles.self_merged(_clusters(spark, sf_dir), ALIKE)


def ag03_embedding_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-03 and ST-11: spans that a speaker's voice is learned from: clean speech, or all if there is none; long spans, or all if there is none."""
    return profiles.embedding_spans(turns(spark, sf_dir))


def so03_turn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-03: each channel's turns by start and speaker."""
    place = F.row_number().over(W.partitionBy("channel").orderBy("start_us", "speaker", "end_us", "seq"))
    return turns(spark, sf_dir).select("channel", "seq", place.alias("place"))


def fn24_short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-24: labels SPEAKER_07 as S7; every third is of another kind and stays."""
    label = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("spk_"), F.col("user_id").cast("string"))).otherwise(F.format_string("SPEAKER_%02d", "user_id"))
    return read(spark, sf_dir, "events").select("user_id").distinct().select("user_id", profiles.short_label(label).alias("label"))


def fn17_recased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-17: the next item's first word in the case that an item's first word allows; even items' words are terms in lower case."""
    word = F.split("text", " ")[0]
    rows = read(spark, sf_dir, "benchmark").select("item_id", word.alias("core"))
    term = rows.select((F.col("item_id") - 1).alias("item_id"), F.when(F.col("item_id") % 2 == 0, F.lower("core")).otherwise(F.initcap("core")).alias("term"))
    heard = F.when(F.col("item_id") % 3 == 0, F.lower("core")).otherwise(F.col("core"))
    return rows.join(term, "item_id").select("item_id", profiles.recased(F.col("term"), heard, F.col("term")).alias("word"))


def wn14_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-14 and EV-01: places of a turn's reference where either of two hearings differs, united when at most two words apart from the furthest end so far."""
    rows = _pairs(spark, sf_dir).withColumn("other", F.filter("ref", lambda w, i: i % 4 != 3))
    spans = [rows.select("conv_id", "turn", F.explode(matching.opcodes("ref", c)).alias("o")).where("o.tag <> 'equal'").select("conv_id", "turn", "o.i1", "o.i2") for c in ("hyp", "other")]
    return intervals.merge_gaps(spans[0].unionByName(spans[1]), ["conv_id", "turn"], "i1", "i2", 2)


def snk11_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11: a note per meeting with front matter and the quoted transcript, as its digest."""
    line = F.concat(F.lit("**"), F.col("speaker"), F.lit("** ["), T.clock(F.col("start_us")), F.lit("]: "), F.col("text"))
    rows = entries(spark, sf_dir).groupBy("meeting").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "end_us", "seq", line.alias("x")))), lambda s: s["x"]).alias("lines"))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("meeting") * 60)
    made = profiles.note(F.concat(F.lit('Meeting "'), F.col("meeting").cast("string"), F.lit('"')), created, F.when(F.col("meeting") % 2 == 0, "en"), F.lit("- one\n- two\n\n"), F.col("lines"))
    return rows.select("meeting", F.md5(made).alias("digest"), F.char_length(made).alias("n_chars"))


_W = f"WITH {EVENTS_SQL}"
_COUNTS = """WITH m AS (SELECT DISTINCT conv_id AS meeting FROM conversations), c AS (SELECT meeting, CASE WHEN meeting % 4 < 3 THEN CAST(meeting % 4 AS INT) END AS local,
CASE WHEN meeting % 5 < 4 THEN CASE WHEN meeting % 4 = 0 AND meeting % 5 = 0 THEN 1 ELSE CAST(meeting % 5 AS INT) END END AS remote, CASE WHEN meeting % 7 = 0 THEN true END AS switch FROM m)"""
_CLUSTERS = """WITH RECURSIVE nv AS (SELECT vec_id, vec_id // 2 AS channel, vec_id % 2 AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
mix(label, x, y) AS (VALUES ('S0', 1.0::DOUBLE, 0.0::DOUBLE), ('S1', 0.9, 0.3), ('S2', 0.6, 0.7), ('S3', 0.0, 1.0)),
m AS (SELECT a.channel, label, list_transform(list_zip(a.v, b.v), lambda z: z[1] * x + z[2] * y) AS v FROM nv a JOIN nv b ON a.channel = b.channel AND a.k = 0 AND b.k = 1, mix),
c AS (SELECT channel, label, list_transform(v, lambda q: q / sqrt(list_dot_product(v, v))) AS v FROM m)"""
_CLOCK = "(CASE WHEN start_us // 1000000 >= 3600 THEN CAST(start_us // 3600000000 AS VARCHAR) || ':' || lpad(CAST(start_us // 60000000 % 60 AS VARCHAR), 2, '0') ELSE CAST(start_us // 60000000 AS VARCHAR) END || ':' || lpad(CAST(start_us // 1000000 % 60 AS VARCHAR), 2, '0'))"
QUERIES = {f.__name__: f for f in (
    prj07_unit_vectors, prj09_named_entries, prj11_planned_channels, prj13_modes, jn08_assigned, se07_self_merged, ag03_embedding_spans, so03_turn_order, fn24_short_labels, fn17_recased, wn14_sites, snk11_notes,
)}
ORACLE_SQL = {
    "prj07_unit_vectors": """WITH z AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0.0::DOUBLE) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
u AS (SELECT vec_id, CASE WHEN list_dot_product(v, v) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS v FROM z) SELECT vec_id, round(v[1], 6) AS first, round(list_dot_product(v, v), 6) AS length2 FROM u""",
    "prj09_named_entries": f"WITH {ENTRIES_SQL} SELECT meeting, seq, coalesce(c_name, CASE WHEN speaker = 'user' THEN 'user' || meeting ELSE speaker END) AS speaker FROM entries LEFT JOIN customer ON speaker = 'user' AND c_custkey = meeting",
    "prj11_planned_channels": _COUNTS + """, r AS (SELECT meeting, 'mic' AS channel, local AS speakers FROM c UNION ALL SELECT meeting, 'system', remote FROM c)
SELECT *, CASE WHEN speakers IS NULL THEN 'estimate' WHEN speakers = 1 THEN 'single' ELSE 'diarize' END AS plan FROM r WHERE speakers IS DISTINCT FROM 0""",
    "prj13_modes": _COUNTS + """ SELECT meeting, CASE WHEN remote = 0 THEN 'in_room' WHEN local IS NULL OR remote IS NULL THEN NULL WHEN local <= 1 THEN 'online' ELSE 'hybrid' END AS mode,
coalesce(switch, coalesce(local > 1, true) OR coalesce(remote > 1, true)) AS diarizes FROM c""",
    "jn08_assigned": _CLUSTERS + """, p AS (SELECT channel, vec_id AS profile, list_transform(v, lambda q: q / sqrt(list_dot_product(v, v))) AS p FROM nv),
s AS (SELECT channel, label, profile, round(list_dot_product(v, p), 6) AS score FROM c JOIN p USING (channel)), k AS (SELECT * FROM s WHERE score >= 0.56),
one AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY channel ORDER BY score DESC, label DESC, profile DESC) = 1),
two AS (SELECT k.* FROM k JOIN one USING (channel) WHERE k.label <> one.label AND k.profile <> one.profile QUALIFY row_number() OVER (PARTITION BY channel ORDER BY k.score DESC, k.label DESC, k.profile DESC) = 1)
SELECT * FROM one UNION ALL SELECT * FROM two""",
    "se07_self_merged": _CLUSTERS + f""", e AS (SELECT a.channel, a.label AS x, b.label AS y FROM c a JOIN c b ON a.channel = b.channel AND list_dot_product(a.v, b.v) >= {ALIKE}),
t AS (SELECT channel, label AS x, label AS y FROM c UNION SELECT t.channel, t.x, e.y FROM t JOIN e ON t.channel = e.channel AND t.y = e.x) SELECT channel, x AS label, min(y) AS "into" FROM t GROUP BY channel, x""",
    "ag03_embedding_spans": _OWN + """, pieces AS (SELECT o.channel, o.speaker, s.start_us, s.end_us FROM own o JOIN steps s ON o.channel = s.channel AND s.depth = 1 AND s.start_us >= o.start_us AND s.end_us <= o.end_us),
g AS (SELECT *, CASE WHEN lag(end_us) OVER w = start_us THEN 0 ELSE 1 END AS o FROM pieces WINDOW w AS (PARTITION BY channel, speaker ORDER BY start_us)),
h AS (SELECT *, sum(o) OVER (PARTITION BY channel, speaker ORDER BY start_us) AS r FROM g), clean AS (SELECT channel, speaker, min(start_us) AS start_us, max(end_us) AS end_us FROM h GROUP BY channel, speaker, r),
spans AS (SELECT * FROM clean UNION ALL SELECT channel, speaker, start_us, end_us FROM own ANTI JOIN clean USING (channel, speaker)), l AS (SELECT *, max(end_us - start_us) OVER (PARTITION BY channel, speaker) AS longest FROM spans)
SELECT channel, speaker, start_us, end_us FROM l WHERE end_us - start_us >= 500000 OR longest < 500000""",
    "so03_turn_order": _W + " SELECT channel, seq, row_number() OVER (PARTITION BY channel ORDER BY start_us, speaker, end_us, seq) AS place FROM turns",
    "fn24_short_labels": "SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'spk_' || user_id ELSE 'S' || user_id END AS label FROM events",
    "fn17_recased": """WITH r AS (SELECT item_id, string_split(text, ' ')[1] AS core FROM benchmark), t AS (SELECT item_id - 1 AS item_id, CASE WHEN item_id % 2 = 0 THEN lower(core) ELSE upper(core[1]) || lower(core[2:]) END AS term FROM r),
h AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN lower(core) ELSE core END AS core, term FROM r JOIN t USING (item_id))
SELECT item_id, CASE WHEN term = lower(term) AND core[1] <> lower(core[1]) THEN upper(term[1]) || term[2:] ELSE term END AS word FROM h""",
    "snk11_notes": f"""WITH {ENTRIES_SQL}, l AS (SELECT meeting, string_agg('> **' || speaker || '** [' || {_CLOCK} || ']: ' || text, chr(10) || '>' || chr(10) ORDER BY start_us, end_us, seq) AS q FROM entries GROUP BY meeting),
n AS (SELECT meeting, concat_ws(chr(10), '---', 'title: "Meeting ''' || meeting || '''"', 'date: ' || strftime(make_timestamp((1704067200 + meeting * 60) * 1000000), '%Y-%m-%d'), 'created: ' || strftime(make_timestamp((1704067200 + meeting * 60) * 1000000), '%Y-%m-%dT%H:%M'),
'type: meeting', CASE WHEN meeting % 2 = 0 THEN 'language: en' END, 'tags: [meeting]', '---', '', '# Meeting "' || meeting || '"', '', '- one' || chr(10) || '- two', '', '> [!quote]- Transcript', q) || chr(10) AS t FROM l)
SELECT meeting, md5(t) AS digest, CAST(length(t) AS INT) AS n_chars FROM n""",
}
