"""Queries on transcript texts, terms and documents."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import transcripts
from ..sources.derived import ENTRIES_SQL, entries, read

#: Words drawn from the pool for each item.
DRAWN = 2
#: Parts of a role in the round-robin draw, and conversations in a stretch of the numbering.
PARTS, STRETCH = 256, 1000


def ag05_language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-05 and FN-08: de or en per document by weighted votes."""
    return read(spark, sf_dir, "documents").select("doc_id", T.language_vote(F.coalesce("text", F.lit(""))).alias("language"))


def ev25_mixed_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-25: two probes per document, the first and the second half; mixed if both are called and differ."""
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", text.alias("t")).withColumn("a", F.expr("substring(t, 1, cast(floor(char_length(t) / 2) as int))")).withColumn("b", F.expr("substring(t, cast(floor(char_length(t) / 2) as int) + 1)"))
    probes = rows.select("doc_id", T.language_vote(F.col("a")).alias("first"), T.language_vote(F.col("b")).alias("second"))
    return probes.withColumn("mixed", F.coalesce(F.col("first") != F.col("second"), F.lit(False)))


def snk01_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01 and FN-02: each meeting as Markdown."""
    return transcripts.markdown(entries(spark, sf_dir).withColumn("provisional", F.col("seq") % 5 == 0))


def snk02_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: each meeting as plain text."""
    return transcripts.plain(entries(spark, sf_dir))


def snk03_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03: each meeting as JSON, with its language (unknown for every third), profile and parameters, and provisional entries."""
    rows = entries(spark, sf_dir).withColumn("provisional", F.col("seq") % 5 == 0)
    language = F.when(F.col("meeting") % 3 == 1, "de").when(F.col("meeting") % 3 == 2, "en")
    profile = F.struct(F.lit("call").alias("mode"), F.countDistinct("speaker").alias("speakers"), (F.count(F.lit(1)) > 1).alias("diarizes"))
    about = rows.groupBy("meeting").agg(profile.alias("profile")).select("meeting", language.alias("language"), "profile", F.struct(F.lit(0.56).alias("threshold")).alias("parameters"))
    return transcripts.json_documents(rows, about=about)


def _timed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with timed words: each turn's time is shared by its characters; every fifth turn has no words."""
    rows = entries(spark, sf_dir)
    said = rows.where("seq % 5 > 0 and text <> ''").withColumn("_rate", (F.col("end_us") - F.col("start_us")) / F.greatest(F.char_length("text"), F.lit(1)))
    each = said.select("meeting", "seq", "start_us", "_rate", F.posexplode(F.split("text", " ")).alias("i", "word"))
    at = F.sum(F.char_length("word") + 1).over(W.partitionBy("meeting", "seq").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.char_length("word") - 1
    placed = each.withColumn("_at", at)
    time = lambda n: F.col("start_us") + F.floor(n * F.col("_rate")).cast("long")
    word = F.struct("i", time(F.col("_at")).alias("start_us"), time(F.col("_at") + F.char_length("word")).alias("end_us"), F.col("word").alias("text"))
    made = placed.groupBy("meeting", "seq").agg(F.array_sort(F.collect_list(word)).alias("ws"))
    timed = made.select("meeting", "seq", F.transform("ws", lambda w: F.struct(w["start_us"].alias("start_us"), w["end_us"].alias("end_us"), w["text"].alias("text"))).alias("ws"))
    return rows.join(timed, ["meeting", "seq"], "left").select("meeting", "seq", "speaker", "text", "start_us", "end_us", "ws")


def snk04_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04, FN-01, SO-02, WN-04 and WN-05: each meeting as SRT, turns with timed words cut into short cues."""
    return transcripts.srt(_timed_entries(spark, sf_dir))


def snk05_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-05 and FN-03: each meeting as WebVTT."""
    return transcripts.vtt(_timed_entries(spark, sf_dir))


def fn01_subtitle_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-01 and FN-02: times of entries in both forms."""
    return entries(spark, sf_dir).select("meeting", "seq", T.subtitle_time(F.col("start_us"), ",").alias("srt"), T.clock(F.col("start_us")).alias("clock"))


def fn05_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-05 and FN-13: tokens of the benchmark with lead, core and trail, and their place."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("place", "token"))
    return rows.select("item_id", "place", T.punctuation_parts(F.col("token")).alias("p")).select("item_id", "place", "p.lead", "p.core", "p.trail")


def fn06_plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-06 and FN-07: words of conversation turns."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.plain_words(F.coalesce("text", F.lit(""))), " ").alias("words"))


def fn15_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-15: the surface forms of benchmark tokens."""
    return _terms(spark, sf_dir).select("term", F.array_join(T.surface_forms(F.col("term")), "|").alias("forms"))


def fn18_meeting_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-18: the time in folder names made from events, some broken."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd-HHmmss")
    name = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("notes-"), stamp)).otherwise(F.concat(F.lit("meeting-"), stamp))
    made = F.unix_seconds(T.meeting_time(name)) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", made.alias("seconds"))


def fn19_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-19 and SNK-09: file names from page addresses, numbered when equal."""
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), T.slug(F.coalesce("url", F.lit(""))).alias("base"))
    return transcripts.free_names(rows, "base", " (", ")").select(F.col("seq").alias("page_id"), "name")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("token"))
    core = F.regexp_extract("token", r"^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$", 1)
    return tokens.select(core.alias("term")).where("term <> ''").distinct()


def ag20_common_and_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-20 and SE-02: the words of conversations without the 20 most frequent."""
    counted = read(spark, sf_dir, "conversations").select(F.explode(T.plain_words(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    common = counted.orderBy(F.desc("n"), "word").limit(20)
    return counted.join(F.broadcast(common.select("word")), "word", "left_anti")


def _rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rare): the words of each benchmark item without the 20 most frequent."""
    common = read(spark, sf_dir, "benchmark").select(F.explode(T.plain_words(F.col("text"))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(20).agg(F.array_sort(F.collect_list("w")).alias("common"))
    return read(spark, sf_dir, "benchmark").crossJoin(F.broadcast(common)).select("item_id", F.array_except(T.plain_words(F.col("text")), F.col("common")).alias("rare"))


def ag21_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21: per benchmark item its words outside the common ones; ``se03_biasing_words`` adds the draw."""
    return _rare_words(spark, sf_dir).select("item_id", F.array_join(F.array_sort("rare"), " ").alias("rare"), F.size("rare").alias("n_rare"))


def se03_biasing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21 and SE-03: per benchmark item its rare words and ``DRAWN`` of the pool of all rare words, from the item's own place on in hash order, round the end."""
    rare = _rare_words(spark, sf_dir)
    pool = rare.select(F.explode("rare").alias("word")).distinct()
    # Numbered in hash order by ranges of the hash, of which only the counts come together.
    ranged = pool.withColumn("_range", F.conv(F.substring(F.md5("word"), 1, 3), 16, 10).cast("int"))
    held = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # 4,096 rows at most
    before = F.lit([0, *accumulate(held.get(k, 0) for k in range(4095))])
    placed = ranged.withColumn("place", F.row_number().over(W.partitionBy("_range").orderBy(F.md5("word"), "word")) - 1 + F.get(before, F.col("_range")))
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    first = F.conv(F.substring(F.md5(F.concat(F.lit("item:"), F.col("item_id").cast("string"))), 1, 8), 16, 10).cast("long")
    slots = rare.crossJoin(F.broadcast(size)).where("size > 0").select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(DRAWN), "size") - 1), lambda j: (first + j) % F.col("size"))).alias("place"))
    drawn = slots.join(placed, "place").groupBy("item_id").agg(F.collect_set("word").alias("drawn"))
    none = F.array().cast("array<string>")
    joined = rare.join(drawn, "item_id", "left").select("item_id", F.coalesce("rare", none).alias("rare"), F.coalesce("drawn", none).alias("drawn"))
    words = lambda column: F.array_join(F.array_sort(column), " ")
    return joined.select("item_id", words(F.col("drawn")).alias("drawn"), words(F.array_union("rare", "drawn")).alias("biasing"))


def se01_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-01 and TX-04: terms of roles, event types and sources in one ordered list, the first of equals."""
    parts = [("conversations", "role"), ("events", "event_type"), ("documents", "source"), ("documents", "lang")]
    lists = [read(spark, sf_dir, t).select(F.lit(i).alias("list"), F.lower(F.col(c)).alias("term")).distinct() for i, (t, c) in enumerate(parts)]
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    first = rows.where("term is not null").groupBy("term").agg(F.min("list").alias("list"))
    return first


def se04_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE-04: whether the roles of a conversation are all among two."""
    roles = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", (F.size(F.array_except("roles", F.array(F.lit("user"), F.lit("assistant")))) == 0).alias("inside"))


def so07_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-07: 50 conversation turns, round-robin over roles, then in order."""
    rows = read(spark, sf_dir, "conversations").withColumn("part", F.pmod(F.xxhash64("conv_id"), F.lit(PARTS)))
    few = rows.withColumn("n", F.row_number().over(W.partitionBy("role", "part").orderBy("conv_id", "turn"))).where("n <= 50")  # no more of a part can be picked
    n = F.row_number().over(W.partitionBy("role").orderBy("conv_id", "turn"))
    picked = few.withColumn("n", n).orderBy("n", "role").limit(50)
    return picked.select("conv_id", "turn", "role")


def so04_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-04 and SRC-07: the greatest meeting name that has a transcript."""
    folders = read(spark, sf_dir, "conversations").select(F.format_string("meeting-%08d", "conv_id").alias("name"), (F.col("conv_id") % 3 > 0).alias("has_transcript")).distinct()
    return transcripts.latest_meeting(folders)


def so09_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-09: every 10th turn of each role by order; turns are numbered within stretches of conversations first, so that a role is not one task."""
    rows = read(spark, sf_dir, "conversations").withColumn("stretch", F.expr(f"conv_id div {STRETCH}"))
    sizes = rows.groupBy("role", "stretch").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("role").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("role", "stretch").orderBy("conv_id", "turn"))
    numbered = rows.withColumn("n", within).join(sizes.select("role", "stretch", before.alias("before")), ["role", "stretch"])
    return numbered.where("(n + before) % 10 = 1").select("conv_id", "turn")


def prj12_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-12: explicit over detected over default language, with where it came from."""
    explicit = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    found = T.language_vote(F.coalesce("text", F.lit("")))
    rows = read(spark, sf_dir, "documents").select("doc_id", explicit.alias("e"), found.alias("d"))
    came = F.when(F.col("e").isNotNull(), "explicit").when(F.col("d").isNotNull(), "detected").otherwise("default")
    return rows.select("doc_id", F.coalesce("e", "d", F.lit("en")).alias("value"), came.alias("provenance"))


def ag22_relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-22: relative change of length from turn to turn; null from nothing."""
    before = F.lag(F.char_length(F.coalesce("text", F.lit("")))).over(W.partitionBy("conv_id").orderBy("turn"))
    now = F.char_length(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.when(before > 0, (now - before) / before), 6).alias("change"))


def ag16_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-16: conversations by number of turns: under 3, 3 to 8, 8 and more; empty buckets stay."""
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("n") < 3, "<3").when(F.col("n") < 8, "3-8").otherwise(">=8")
    counted = n.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("conversations"))
    names = spark.range(3).select(F.element_at(F.array(F.lit("<3"), F.lit("3-8"), F.lit(">=8")), (F.col("id") + 1).cast("int")).alias("bucket"))
    return names.join(counted, "bucket", "left").select("bucket", F.coalesce("conversations", F.lit(0)).alias("conversations"))


def ev24_channel_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-24: words of each conversation's roles that start with u, in order, as a count and a text."""
    rows = read(spark, sf_dir, "conversations").where(F.startswith("role", F.lit("u"))).select("conv_id", "turn", F.posexplode(T.plain_words(F.coalesce("text", F.lit("")))).alias("place", "word"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "place", "word"))), lambda x: x["word"]), " ").alias("words"))


_L = "lower(coalesce({t}, ''))"


def _votes(t: str) -> str:
    low = _L.format(t=t)
    words = f"regexp_extract_all({low}, '\\p{{L}}+')"
    listed = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    g = f"len(list_filter({words}, lambda w: list_contains({listed(T.GERMAN)}, w))) + 3 * (length({low}) - length(translate({low}, 'äöüß', '')))"
    e = f"len(list_filter({words}, lambda w: list_contains({listed(T.ENGLISH)}, w)))"
    return f"CASE WHEN {g} + {e} >= 3 AND {g} > {e} THEN 'de' WHEN {g} + {e} >= 3 AND {e} > {g} THEN 'en' END"


_WORDS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\p{M}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_MS = "CAST(round_even(greatest(start_us, 0) / 1000.0, 0) AS BIGINT)"
_SRT = f"(CASE WHEN {_MS} // 3600000 < 100 THEN lpad(CAST({_MS} // 3600000 AS VARCHAR), 2, '0') ELSE CAST({_MS} // 3600000 AS VARCHAR) END || ':' || lpad(CAST({_MS} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({_MS} % 60000 // 1000 AS VARCHAR), 2, '0') || ',' || lpad(CAST({_MS} % 1000 AS VARCHAR), 3, '0'))"
_CLOCK = "(CASE WHEN start_us // 1000000 >= 3600 THEN CAST(start_us // 3600000000 AS VARCHAR) || ':' || lpad(CAST(start_us // 60000000 % 60 AS VARCHAR), 2, '0') ELSE CAST(start_us // 60000000 AS VARCHAR) END || ':' || lpad(CAST(start_us // 1000000 % 60 AS VARCHAR), 2, '0'))"
_CORE = "regexp_extract(token, '^[^\\p{L}\\p{N}]*(.*?)[^\\p{L}\\p{N}]*$', 1)"
QUERIES = {f.__name__: f for f in (
    ag05_language_vote, ev25_mixed_language, snk01_markdown, snk02_plain, snk03_json, snk04_srt, snk05_vtt, fn01_subtitle_times, fn05_punctuation, fn06_plain_words, fn15_surface_forms,
    fn18_meeting_time, fn19_slug, ag20_common_and_rare, ag21_rare_words, se03_biasing_words, se01_vocabulary, se04_subset, so04_latest, so07_round_robin, so09_every_nth, prj12_resolved, ag22_relative_change,
    ag16_density, ev24_channel_words,
)}
ORACLE_SQL = {
    "snk03_json": f"""WITH {ENTRIES_SQL}, e AS (SELECT meeting, list({{'start_us': start_us, 'end_us': end_us, 'seq': seq, 'speaker': speaker, 'text': text, 'provisional': seq % 5 = 0}} ORDER BY start_us, end_us, seq) AS es, count(DISTINCT speaker) AS n, count(*) AS m FROM entries GROUP BY meeting)
SELECT meeting, CAST(to_json({{'version': 1, 'language': [NULL, 'de', 'en'][meeting % 3 + 1], 'profile': {{'mode': 'call', 'speakers': n, 'diarizes': m > 1}}, 'parameters': {{'threshold': 0.56::DOUBLE}}, 'entries': es}}) AS VARCHAR) AS text FROM e""",
    "ag05_language_vote": f"SELECT doc_id, {_votes('text')} AS language FROM documents",
    "ev25_mixed_language": f"""WITH h AS (SELECT doc_id, substring(coalesce(text, ''), 1, length(coalesce(text, '')) // 2) AS a, substring(coalesce(text, ''), length(coalesce(text, '')) // 2 + 1) AS b FROM documents),
p AS (SELECT doc_id, {_votes('a')} AS first, {_votes('b')} AS second FROM h) SELECT *, coalesce(first <> second, false) AS mixed FROM p""",
    "snk01_markdown": f"WITH {ENTRIES_SQL} SELECT meeting, string_agg('**' || speaker || '** [' || {_CLOCK} || ']' || CASE WHEN seq % 5 = 0 THEN ' *(overlap)*' ELSE '' END || ': ' || text, chr(10) || chr(10) ORDER BY start_us, end_us, seq) AS text FROM entries GROUP BY meeting",
    "snk02_plain": f"WITH {ENTRIES_SQL} SELECT meeting, string_agg(speaker || ': ' || text, chr(10) ORDER BY start_us, end_us, seq) AS text FROM entries GROUP BY meeting",
    "fn01_subtitle_times": f"WITH {ENTRIES_SQL} SELECT meeting, seq, {_SRT} AS srt, {_CLOCK} AS clock FROM entries",
    "fn05_punctuation": f"""WITH t AS (SELECT item_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS place FROM benchmark)
SELECT item_id, place, regexp_extract(token, '^([^\\p{{L}}\\p{{N}}]*)', 1) AS lead, {_CORE} AS core, CASE WHEN {_CORE} = '' THEN '' ELSE regexp_extract(token, '([^\\p{{L}}\\p{{N}}]*)$', 1) END AS trail FROM t""",
    "fn06_plain_words": f"SELECT conv_id, turn, array_to_string({_WORDS}, ' ') AS words FROM conversations",
    "fn15_surface_forms": f"""WITH t AS (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark), u AS (SELECT DISTINCT {_CORE} AS term FROM t)
SELECT term, CASE WHEN lower(term) = term AND replace(upper(term[1]), 'ẞ', 'SS') || term[2:] <> term THEN term || '|' || replace(upper(term[1]), 'ẞ', 'SS') || term[2:] ELSE term END AS forms FROM u WHERE term <> ''""",
    "fn18_meeting_time": "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 END AS seconds FROM events",
    "fn19_slug": """WITH s AS (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(url, ''), '[\\\\/:*?"<>|\\x00-\\x1f]', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM pages),
b AS (SELECT page_id, CASE WHEN trim(substring(c, 1, 80)) = '' THEN 'Meeting' ELSE trim(substring(c, 1, 80)) END AS base FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM b)
SELECT page_id, CASE WHEN n = 1 THEN base ELSE base || ' (' || n || ')' END AS name FROM n""",
    "ag20_common_and_rare": f"WITH w AS (SELECT unnest({_WORDS}) AS word FROM conversations), c AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT word, n FROM c WHERE word NOT IN (SELECT word FROM c ORDER BY n DESC, word LIMIT 20)",
    "ag21_rare_words": f"""WITH w AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), c AS (SELECT w FROM w GROUP BY w ORDER BY count(*) DESC, w LIMIT 20), r AS (SELECT DISTINCT item_id, w FROM w WHERE w NOT IN (SELECT w FROM c))
SELECT b.item_id, coalesce(string_agg(w, ' ' ORDER BY w), '') AS rare, count(w) AS n_rare FROM benchmark b LEFT JOIN r USING (item_id) GROUP BY b.item_id""",
    "se03_biasing_words": f"""WITH w AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), c AS (SELECT w FROM w GROUP BY w ORDER BY count(*) DESC, w LIMIT 20), r AS (SELECT DISTINCT item_id, w FROM w WHERE w NOT IN (SELECT w FROM c)),
p AS (SELECT w, row_number() OVER (ORDER BY md5(w), w) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT w FROM r)),
d AS (SELECT item_id, w FROM (SELECT item_id, CAST('0x' || substring(md5('item:' || item_id), 1, 8) AS BIGINT) AS first FROM benchmark) b JOIN p ON (p.place - b.first % p.size + p.size) % p.size < {DRAWN}),
x AS (SELECT item_id, string_agg(w, ' ' ORDER BY w) AS drawn FROM d GROUP BY item_id), u AS (SELECT item_id, string_agg(w, ' ' ORDER BY w) AS biasing FROM (SELECT * FROM r UNION SELECT * FROM d) GROUP BY item_id)
SELECT b.item_id, coalesce(drawn, '') AS drawn, coalesce(biasing, '') AS biasing FROM benchmark b LEFT JOIN x USING (item_id) LEFT JOIN u USING (item_id)""",
    "se01_vocabulary": """WITH u AS (SELECT 0 AS list, lower(role) AS term FROM conversations UNION ALL SELECT 1, lower(event_type) FROM events UNION ALL SELECT 2, lower(source) FROM documents UNION ALL SELECT 3, lower(lang) FROM documents)
SELECT term, min(list) AS list FROM u WHERE term IS NOT NULL GROUP BY term""",
    "se04_subset": "SELECT conv_id, coalesce(bool_and(role IN ('user', 'assistant')), true) AS inside FROM conversations GROUP BY conv_id",
    "so04_latest": "SELECT 'meeting-' || lpad(CAST(max(conv_id) AS VARCHAR), 8, '0') AS name, true AS has_transcript FROM conversations WHERE conv_id % 3 > 0",
    "so07_round_robin": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations) ORDER BY n, role LIMIT 50",
    "so09_every_nth": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations) WHERE n % 10 = 1",
    "prj12_resolved": f"WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS e, {_votes('text')} AS d FROM documents) SELECT doc_id, coalesce(e, d, 'en') AS value, CASE WHEN e IS NOT NULL THEN 'explicit' WHEN d IS NOT NULL THEN 'detected' ELSE 'default' END AS provenance FROM r",
    "ag22_relative_change": "WITH l AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, lag(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, round(CASE WHEN b > 0 THEN (n - b) / b END, 6) AS change FROM l",
    "ag16_density": """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), b AS (SELECT CASE WHEN n < 3 THEN '<3' WHEN n < 8 THEN '3-8' ELSE '>=8' END AS bucket FROM n), k(bucket) AS (VALUES ('<3'), ('3-8'), ('>=8'))
SELECT k.bucket, count(b.bucket) AS conversations FROM k LEFT JOIN b USING (bucket) GROUP BY k.bucket""",
    "ev24_channel_words": f"""WITH w AS (SELECT conv_id, turn, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS place FROM conversations WHERE starts_with(role, 'u'))
SELECT conv_id, count(*) AS n_words, string_agg(word, ' ' ORDER BY turn, place) AS words FROM w GROUP BY conv_id""",
}
