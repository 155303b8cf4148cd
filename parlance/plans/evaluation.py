"""Queries of the evaluation rows: verdicts, gates, arms, weighted rates, and notes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import intervals, matching, notes, records, speech, voices
from ..sources.derived import ENTRIES_SQL, EVENTS_SQL, entries, read, turns, words
from .scoring import _pairs
from .speech import _MERGED
from .voices import _SQL as VOICES_SQL
from .voices import _profiles, _scored, _trials


def _two_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates of two hearings of each turn: one loses words, the other every fourth word."""
    rows = _pairs(spark, sf_dir).withColumn("other", F.filter("ref", lambda w, i: i % 4 != 3))
    a = matching.error_counts(rows.select("conv_id", "turn", "ref", "hyp"), "ref", "hyp").select("conv_id", "turn", F.col("wer").alias("wer_a"))
    b = matching.error_counts(rows.select("conv_id", "turn", "ref", "other"), "ref", "other").select("conv_id", "turn", F.col("wer").alias("wer_b"))
    return a.join(b, ["conv_id", "turn"])


def ev06_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-06 and EV-09: which hearing is better, and whether speech was dropped (rate over 0.6)."""
    verdict = F.when(F.col("wer_a").isNull(), "no-ref").when(F.col("wer_a") < F.col("wer_b"), "A").when(F.col("wer_b") < F.col("wer_a"), "B").otherwise("tie")
    return _two_arms(spark, sf_dir).select("conv_id", "turn", verdict.alias("verdict"), F.coalesce(F.col("wer_a") > 0.6, F.lit(False)).alias("dropped"))


def ev08_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-08: verdicts per role."""
    rows = ev06_verdicts(spark, sf_dir).join(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return rows.groupBy("role").pivot("verdict", ["A", "B", "tie", "no-ref"]).count().fillna(0)


def ev10_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-10: corrections that give a word of the benchmark (a true fix) or not (a false insertion)."""
    pool = read(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).distinct()
    made = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("w"))
    flagged = made.join(pool.withColumn("known", F.lit(True)), "w", "left")
    return flagged.groupBy("conv_id").agg(F.count_if("known").alias("fixes"), F.count_if(F.col("known").isNull()).alias("insertions"))


def ev11_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-11: the source with the shortest mean text as best of its language, and whether means rise with the source's number."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    per = read(spark, sf_dir, "documents").where("lang is not null").groupBy("lang", number.alias("n")).agg(F.avg("n_chars").alias("mean"))
    order = W.partitionBy("lang").orderBy("n")
    rows = per.withColumn("falls", F.col("mean") < F.lag("mean").over(order))
    return rows.groupBy("lang").agg(F.min_by("n", F.struct("mean", "n")).alias("best"), (F.count_if("falls") == 0).alias("monotone"))


def ev14_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-14: per trial the best score by one vector, by the mean, and by the best of a profile's two vectors."""
    trials, profiles = _trials(spark, sf_dir), _profiles(spark, sf_dir)
    pairs = voices.mean_profiles(profiles.withColumn("profile", F.expr("profile div 2")))
    arms = [("single", profiles.where("profile % 2 = 0")), ("average", pairs), ("best", profiles)]
    each = [voices.highest_scores(trials, p).groupBy("trial").agg(F.round(F.max("score"), 6).alias(name)) for name, p in arms]
    return each[2].join(each[0], "trial", "left").join(each[1], "trial", "left").select("trial", "single", "average", "best")


def ev16_duration_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-16: scores of trials with too little speech count as -1."""
    top = voices.best_match(_scored(spark, sf_dir), -2.0)
    return top.select("trial", F.when(F.abs("trial") % 4 == 0, -1.0).otherwise(F.round("score", 6)).alias("score"))


def ev17_weighted_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-17: share of speech with the speaker's own event type as text, by time and by speaker."""
    w = words(spark, sf_dir).select("channel", "text", "start_us", "end_us")
    t = turns(spark, sf_dir).select("channel", "speaker", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    both = intervals.overlap(w, t, ["channel"], ("start_us", "end_us"), ("t_start", "t_end"), speech.BIN_US)
    per = both.groupBy("speaker").agg(F.sum("shared").alias("total"), F.sum(F.when(F.col("text") == F.col("speaker"), F.col("shared")).otherwise(0)).alias("right"))
    return per.agg(F.round(F.sum("right") / F.sum("total"), 6).alias("by_time"), F.round(F.avg(F.col("right") / F.col("total")), 6).alias("by_speaker"))


def ev20_clean_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-20: frames where one speaker talks alone, for speakers of a channel with ten such frames or more."""
    spans = matching.frame_spans(turns(spark, sf_dir))
    alone = intervals.depth(spans, ["channel"], "low", "high").where("depth = 1").select("channel", "start_us", "end_us")
    own = intervals.overlap(spans, alone, ["channel"], ("low", "high"), ("start_us", "end_us"), matching.FRAME_BIN)
    return own.groupBy("channel", "speaker").agg(F.sum("shared").alias("frames")).where("frames >= 10")


def ev22_echo_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-22: level while one event type plays against the rest, per user; inconclusive if it plays under 20 % or always."""
    playing = F.col("event_type") == "view"
    level = lambda c: 10 * F.log10(F.avg(F.when(c, F.col("value") * F.col("value"))) + 1e-12)
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(playing.cast("double")).alias("share"), (level(playing) - level(~playing)).alias("gain"))
    verdict = F.when((F.col("share") < 0.2) | (F.col("share") == 1) | F.col("gain").isNull(), "inconclusive").when(F.col("gain") >= 6, "echo").otherwise("none")
    return rows.select("user_id", verdict.alias("verdict"))


def ev27_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-27: places of vectors in every third window of eight are zeroed: sums of what is left."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    kept = F.when(F.floor(F.col("i") / 8) % 3 == 0, 0).otherwise(F.floor(F.col("x").cast("double") * 30000).cast("long"))
    return rows.groupBy("vec_id").agg(F.sum(kept).alias("total"))


def jn11_best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11: for each word the united turn that it shares most time with, or null."""
    spans = intervals.merge_gaps(turns(spark, sf_dir).select("channel", "start_us", "end_us"), ["channel"], "start_us", "end_us", 0).select("channel", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    w = words(spark, sf_dir).select("seq", "channel", "start_us", "end_us")
    best = intervals.overlap(w, spans, ["channel"], ("start_us", "end_us"), ("t_start", "t_end"), speech.BIN_US).groupBy("seq").agg(F.min_by("t_start", F.struct(-F.col("shared"), "t_start")).alias("window_us"))
    return w.select("seq").join(best, "seq", "left")


def jn10_region_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10 and EV-07: words whose middle lies within 0.25 s around a turn, in order."""
    t = turns(spark, sf_dir).select("channel", F.col("seq").alias("turn"), (F.col("start_us") - 250_000).alias("t_start"), (F.col("end_us") + 250_001).alias("t_end"))
    found = intervals.stab(words(spark, sf_dir), t, ["channel"], "mid_us", "t_start", "t_end", speech.BIN_US)
    return found.groupBy("turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "seq", "text"))), lambda x: x["text"]), " ").alias("words"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes from conversations: every fifth turn's first words as a heading, a fence at every seventh."""
    line = F.when(F.col("seq") % 7 == 3, "```").when(F.col("seq") % 5 == 0, F.concat(F.lit("## "), "speaker")).otherwise(F.concat(F.lit("- "), "speaker"))
    rows = entries(spark, sf_dir).select("meeting", F.struct("seq", line.alias("x")).alias("l"))
    return rows.groupBy("meeting").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["x"]), "\n").alias("text"))


def fn22_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22: headings outside code fences."""
    return notes.headings(_notes(spark, sf_dir), "meeting", "text")


def fn22_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22: lines with content under each heading."""
    return notes.sections(_notes(spark, sf_dir), "meeting", "text")


def nt03_missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NT-03: headings of a template that notes lack."""
    made = notes.missing_sections(_notes(spark, sf_dir), "meeting", "text", ["User", "Assistant", "Decisions"])
    return made.select("meeting", F.array_join("warnings", "|").alias("warnings"))


def nt04_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NT-04: a prompt per meeting, as its digest."""
    rows = entries(spark, sf_dir).groupBy("meeting").agg(F.array_sort(F.collect_set("speaker")).alias("names"), F.count(F.lit(1)).cast("string").alias("n"))
    title = F.when(F.col("meeting") % 2 == 0, F.concat(F.lit("Meeting "), F.col("meeting").cast("string")))
    return rows.select("meeting", F.md5(notes.prompt(title, F.lit("en"), F.col("names"), F.col("n"))).alias("digest"))


#: Responses around a note's title T and body B, and whether a title is found: plain, fenced, with chatter, a think block, a fence among prose, a fence cut off, no title.
_RESPONSES = [
    ("# {T}\n{B}", True), ("```markdown\n# {T}\n{B}\n```", True), ("Here are your notes!\n\n# {T}\n{B}", True), ("<think>\n# Not this\n</think>\n# {T}\n{B}", True),
    ("Sure:\n```\n# {T}\n{B}\n```\nAnything else?", True), ("~~~\n# {T}\n{B}", True), ("{B}\n<think>cut off\n# Not this", False), ("```\nno heading\n```\n# {T} #\n{B}\n```", True),
]


def fn21_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-21 and FN-20: title and body of notes on every conversation turn, in eight kinds of responses."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Notes "), F.col("conv_id"), F.lit("."), F.col("turn")).alias("t"), F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[`#~<>]", ""), r"^\s+|\s+$", "").alias("b"))
    fill = lambda form: F.replace(F.replace(F.lit(form), F.lit("{T}"), F.col("t")), F.lit("{B}"), F.col("b"))
    response = F.get(F.array(*[fill(form) for form, _ in _RESPONSES]), ((F.col("conv_id") + F.col("turn")) % len(_RESPONSES)).cast("int"))
    return rows.select("conv_id", "turn", notes.unwrap(response).alias("n")).select("conv_id", "turn", "n.title", "n.body")


def wn20_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-20: per vector, places at or above its 90th percentile grown over neighbours above zero."""

    @F.pandas_udf("int")
    def count(x: pd.Series) -> pd.Series:
        return pd.Series([sum(records.hysteresis(list(v), sorted(v)[int(0.9 * (len(v) - 1))], 0.0)) if len(v) else 0 for v in x])

    return read(spark, sf_dir, "embeddings").select("vec_id", count("embedding").alias("n_on"))


def wn21_quiet_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-21: vectors cut at the quietest of seven places around every sixteenth."""

    @F.pandas_udf("array<int>")
    def cuts(x: pd.Series) -> pd.Series:
        return pd.Series([records.quiet_cuts([abs(float(y)) for y in v], 16, 3) for v in x])

    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(cuts("embedding").cast("array<string>"), ",").alias("cuts"))


def ev05_time_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-05: for words that are equal in both hearings of a turn, how far their places differ: median and 90th percentile in places."""
    steps = _pairs(spark, sf_dir).select(F.explode(matching.align("ref", "hyp")).alias("s")).where("s.step = 'm'").select(F.abs(F.col("s.ref") - F.col("s.hyp")).alias("d"))
    return steps.agg(F.expr("percentile_disc(0.5) within group (order by d)").cast("int").alias("p50"), F.expr("percentile_disc(0.9) within group (order by d)").cast("int").alias("p90"), F.count(F.lit(1)).alias("n"))


def ev13_galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-13 and EV-15: word texts of channels by the speaker that dominates them, with their clean time."""
    w = words(spark, sf_dir).select("channel", "text", "start_us", "end_us")
    t = turns(spark, sf_dir).select("channel", "speaker", F.col("start_us").alias("t_start"), F.col("end_us").alias("t_end"))
    both = intervals.overlap(w, t, ["channel"], ("start_us", "end_us"), ("t_start", "t_end"), speech.BIN_US)
    sums = both.groupBy("channel", "text", "speaker").agg(F.sum("shared").alias("shared"))
    owners = sums.groupBy("channel", "text").agg(F.min_by("speaker", F.struct(-F.col("shared"), "speaker")).alias("speaker"), F.max("shared").alias("shared"))
    return owners.groupBy("channel", "speaker").agg(F.array_join(F.array_sort(F.collect_list("text")), ",").alias("texts"), F.sum("shared").alias("shared"))


_W = f"WITH {EVENTS_SQL}"
_FENCED = f"""WITH {ENTRIES_SQL},
l AS (SELECT meeting, row_number() OVER (PARTITION BY meeting ORDER BY seq) - 1 AS line, CASE WHEN seq % 7 = 3 THEN '```' WHEN seq % 5 = 0 THEN '## ' || speaker ELSE '- ' || speaker END AS content FROM entries),
f AS (SELECT *, content = '```' OR coalesce(sum(CAST(content = '```' AS INT)) OVER (PARTITION BY meeting ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM l),
h AS (SELECT *, NOT fenced AND content LIKE '## %' AS head FROM f)"""
QUERIES = {f.__name__: f for f in (
    ev06_verdicts, ev08_tally, ev10_corrections, ev11_gate, ev14_arms, ev16_duration_gate, ev17_weighted_naming, ev20_clean_frames, ev22_echo_path, ev27_masked,
    jn10_region_words, jn11_best_window, fn21_unwrap, fn22_headings, fn22_sections, nt03_missing_sections, nt04_prompt, wn20_hysteresis, wn21_quiet_cuts, ev05_time_deltas, ev13_galleries,
)}
ORACLE_SQL = {
    "ev10_corrections": """WITH p AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM benchmark), m AS (SELECT conv_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+')) AS w FROM conversations)
SELECT conv_id, count(p.w) AS fixes, count(*) - count(p.w) AS insertions FROM m LEFT JOIN p USING (w) GROUP BY conv_id""",
    "ev11_gate": """WITH p AS (SELECT lang, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS n, avg(n_chars) AS mean FROM documents WHERE lang IS NOT NULL GROUP BY ALL), f AS (SELECT *, mean < lag(mean) OVER (PARTITION BY lang ORDER BY n) AS falls FROM p)
SELECT lang, arg_min(n, (mean, n)) AS best, count(*) FILTER (falls) = 0 AS monotone FROM f GROUP BY lang""",
    "ev14_arms": VOICES_SQL + ", a AS (SELECT trial, profile // 2 AS profile, max(score) FILTER (profile % 2 = 0) AS single, avg(score) AS average, max(score) AS best FROM scored GROUP BY ALL) SELECT trial, round(max(single), 6) AS single, round(max(average), 6) AS average, round(max(best), 6) AS best FROM a GROUP BY trial",
    "ev16_duration_gate": VOICES_SQL + " SELECT trial, CASE WHEN abs(trial) % 4 = 0 THEN -1.0 ELSE round(score, 6) END AS score FROM best",
    "ev17_weighted_naming": _W + """, p AS (SELECT t.speaker, sum(least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us)) AS total, sum(CASE WHEN w.text = t.speaker THEN least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us) ELSE 0 END) AS rgt
FROM words w JOIN turns t ON w.channel = t.channel AND w.start_us < t.end_us AND t.start_us < w.end_us GROUP BY t.speaker) SELECT round(sum(rgt) / sum(total), 6) AS by_time, round(avg(rgt / total), 6) AS by_speaker FROM p""",
    "ev20_clean_frames": _W + """, s AS (SELECT channel, speaker, CAST(round_even(start_us / 10000.0, 0) AS BIGINT) AS low, CAST(round_even(end_us / 10000.0, 0) AS BIGINT) AS high FROM turns), f AS (SELECT DISTINCT channel, speaker, unnest(range(low, high)) AS frame FROM s),
a AS (SELECT channel, frame, min(speaker) AS speaker FROM f GROUP BY channel, frame HAVING count(*) = 1) SELECT channel, speaker, count(*) AS frames FROM a GROUP BY channel, speaker HAVING count(*) >= 10""",
    "ev22_echo_path": """WITH r AS (SELECT user_id, avg(CAST(event_type = 'view' AS INT)) AS share, 10 * log10(avg(value * value) FILTER (event_type = 'view') + 1e-12) - 10 * log10(avg(value * value) FILTER (event_type <> 'view') + 1e-12) AS gain FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN share < 0.2 OR share = 1 OR gain IS NULL THEN 'inconclusive' WHEN gain >= 6 THEN 'echo' ELSE 'none' END AS verdict FROM r""",
    "ev27_masked": "WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) SELECT vec_id, CAST(sum(CASE WHEN i // 8 % 3 = 0 THEN 0 ELSE CAST(floor(CAST(x AS DOUBLE) * 30000) AS BIGINT) END) AS BIGINT) AS total FROM s GROUP BY vec_id",
    "jn11_best_window": _W + ", " + _MERGED.format(name="m", gap=0, src="turns", key="channel") + """,
p AS (SELECT w.seq, m.start_us AS t, least(w.end_us, m.end_us) - greatest(w.start_us, m.start_us) AS shared FROM words w JOIN m ON w.channel = m.channel AND w.start_us < m.end_us AND m.start_us < w.end_us),
b AS (SELECT seq, arg_min(t, (-shared, t)) AS window_us FROM p GROUP BY seq) SELECT w.seq, b.window_us FROM words w LEFT JOIN b USING (seq)""",
    "jn10_region_words": _W + " SELECT t.seq AS turn, string_agg(w.text, ' ' ORDER BY w.start_us, w.seq) AS words FROM words w JOIN turns t ON w.channel = t.channel AND w.mid_us BETWEEN t.start_us - 250000 AND t.end_us + 250000 GROUP BY t.seq",
    "fn21_unwrap": f"""SELECT conv_id, turn, CASE WHEN [{', '.join(str(titled) for _, titled in _RESPONSES)}][(conv_id + turn) % {len(_RESPONSES)} + 1] THEN 'Notes ' || conv_id || '.' || turn END AS title,
regexp_replace(regexp_replace(coalesce(text, ''), '[`#~<>]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM conversations""",
    "ev13_galleries": _W + """, p AS (SELECT w.channel, w.text, t.speaker, CAST(sum(least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us)) AS BIGINT) AS shared FROM words w JOIN turns t ON w.channel = t.channel AND w.start_us < t.end_us AND t.start_us < w.end_us GROUP BY w.channel, w.text, t.speaker),
o AS (SELECT channel, text, arg_min(speaker, (-shared, speaker)) AS speaker, max(shared) AS shared FROM p GROUP BY channel, text) SELECT channel, speaker, string_agg(text, ',' ORDER BY text) AS texts, CAST(sum(shared) AS BIGINT) AS shared FROM o GROUP BY channel, speaker""",
    "fn22_headings": _FENCED + " SELECT meeting, line, 2 AS level, content[4:] AS title FROM h WHERE head",
    "fn22_sections": _FENCED + """, s AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY meeting ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM h)
SELECT meeting, section, max(content[4:]) FILTER (head) AS title, count(*) FILTER (NOT head) AS n_lines FROM s GROUP BY meeting, section""",
    "nt03_missing_sections": _FENCED + """, m AS (SELECT DISTINCT meeting FROM h), t(title, k) AS (VALUES ('User', 0), ('Assistant', 1), ('Decisions', 2)), g AS (SELECT m.meeting, t.title, t.k FROM m, t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.meeting = m.meeting AND head AND lower(content[4:]) = lower(t.title)))
SELECT m.meeting, coalesce(string_agg(g.title, '|' ORDER BY k), '') AS warnings FROM m LEFT JOIN g USING (meeting) GROUP BY m.meeting""",
    "nt04_prompt": f"""WITH {ENTRIES_SQL}, r AS (SELECT meeting, list_sort(list(DISTINCT speaker)) AS names, count(*) AS n FROM entries GROUP BY meeting)
SELECT meeting, md5(CASE WHEN meeting % 2 = 0 THEN 'Title: Meeting ' || meeting || chr(10) ELSE '' END || 'Language: en' || chr(10) || 'Attendees: ' || array_to_string(names, ', ') || chr(10) || 'Transcript:' || chr(10) || n) AS digest FROM r""",
}
