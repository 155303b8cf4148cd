"""Streaming queries, run over the events file to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, windows
from ..sources.derived import EVENTS_SQL, WORD_US, read, turns, words
from ..streaming import live, speech


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


def sm01_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-01: the latest end per channel; the last state of each counts."""
    sent = speech.run_to_end(speech.watermarks(speech.stream_events(spark, sf_dir).where("seq % 2 = 0")), _name("sm01"), "complete")
    return sent.select("channel", "watermark_us", "n")


def sm04_online_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-04 and SM-06: online windows; equal to WN-03."""
    sent = speech.run_to_end(speech.online_windows(speech.stream_events(spark, sf_dir).where("seq % 2 = 0")), _name("sm04"), "update")
    return speech.settled(sent, turns(spark, sf_dir).groupBy("channel").agg((F.max("end_us") + 1_000_000).alias("total_us")))


def sm05_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-05 and SM-02: words that do not step back; equal to WN-22."""
    return speech.run_to_end(speech.append_only(speech.stream_events(spark, sf_dir).where("seq % 2 = 1")), _name("sm05"), "append")


def sm09_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-09: records in sliding windows of ten hours each hour."""
    sent = speech.run_to_end(speech.sliding_counts(speech.stream_events(spark, sf_dir)), _name("sm09"), "complete")
    return sent.select((F.unix_seconds("start") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))).alias("second"), "label", "n")


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words as a stream."""
    return speech.stream_events(spark, sf_dir).where("seq % 2 = 1").withColumnRenamed("label", "text").withColumn("end_us", F.col("start_us") + WORD_US)


def _finished(stream: DataFrame, kind: str, ddl: str) -> tuple[DataFrame, str]:
    """All rows that a finite stream sends, each once, and the place of its state."""
    folder = f"{speech.shared_folder(stream.sparkSession)}/{_name(kind)}"
    live.decode_once(stream, folder).awaitTermination()
    return live.committed(stream.sparkSession, folder, ddl), f"{folder}-state"


def sm11_live_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-11: caption lines of two interleaved sides, sent when finished; the lines still open at the end come from the state store."""
    heard = _heard(spark, sf_dir)
    sent, state = _finished(live.live_captions(heard.withColumn("side", live.seen_side(F.col("seq"))), idle_ms=None), "sm11", live.CAPTIONS)
    return sent.unionByName(live.open_rows(spark, state, live.CAPTIONS, "line"))


def sm09_tail_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-09: runs sent once when they are over, and the newest of each channel; equal to WN-02."""
    sent, state = _finished(live.closed_runs(_heard(spark, sf_dir)), "sm09", live.RUNS)
    return sent.unionByName(live.open_rows(spark, state, live.RUNS, "run"))


def sm10_bounded_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-10 and SM-03: frames in the view of each decode window, from a buffer that is trimmed as windows close. Windows still open at the end are not sent."""
    heard = speech.stream_events(spark, sf_dir).withColumn("speech", F.expr("seq % 2 = 0")).withColumn("value", F.lit(1.0) * (F.col("seq") % 100))
    sent, _ = _finished(live.bounded_views(heard), "sm10", live.VIEWS)
    return sent.select("channel", "number", "start_us", "end_us", "from_us", "n", "total")


def _with_words(batch: DataFrame, spoken: DataFrame) -> DataFrame:
    """The words whose middle lies in each window."""
    found = spoken.join(batch, "channel").where("mid_us >= start_us and mid_us < end_us")
    return found.select("channel", "number", "seq", "mid_us")


def sm14_decoded_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-14: the words of each closed decode window from the live pass, and for channels that shed time (ids divisible by 7) from a second pass over all windows."""
    records = speech.stream_events(spark, sf_dir).withColumn("speech", F.expr("seq % 2 = 0")).withColumn("value", F.lit(0.0))
    spoken = words(spark, sf_dir).select("channel", "seq", "mid_us")
    folder = f"{speech.shared_folder(spark)}/{_name('sm14')}"
    closed = live.bounded_views(records.where("speech")).select("channel", "number", "start_us", "end_us")
    live.decode_once(closed, folder, lambda batch: _with_words(batch, spoken)).awaitTermination()
    sent = live.committed(spark, folder, "channel long, number long, seq long, mid_us long")
    shed = read(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.when(F.col("user_id") % 7 == 0, 1).otherwise(0).alias("shed_us")).distinct()
    again = windows.packed(intervals.merge_gaps(turns(spark, sf_dir).select("channel", "start_us", "end_us"), ["channel"], "start_us", "end_us", 0))
    return live.reused(sent.select("channel", "seq"), _with_words(again, spoken).select("channel", "seq"), shed).distinct()


#: Windows before padding, by a fold over the united turns of each channel: (channel, number, start_us, end_us), and whether a later turn closed it.
WINDOWS_SQL = EVENTS_SQL + """,
mx AS (SELECT channel, start_us, end_us, max(end_us) OVER (PARTITION BY channel ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns),
mg AS (SELECT *, sum(CASE WHEN before IS NULL OR start_us > before THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM mx),
seg AS (SELECT channel, min(start_us) AS s, max(end_us) AS e, row_number() OVER (PARTITION BY channel ORDER BY min(start_us)) AS i FROM mg GROUP BY channel, g),
cut AS (SELECT channel, i, s, e, CASE WHEN e - s > 30000000 THEN (e - s + 29999999) // 30000000 ELSE 1 END AS k FROM seg),
fold AS (
  SELECT channel, i, k AS n, s + (k - 1) * 30000000 AS ws, e AS we FROM cut WHERE i = 1
  UNION ALL
  SELECT c.channel, c.i, CASE WHEN joins THEN n ELSE n + k END, CASE WHEN joins THEN ws ELSE s + (k - 1) * 30000000 END, e
  FROM (SELECT f.n, f.ws, c.*, e - s <= 30000000 AND e - ws <= 30000000 AND s - we <= 5000000 AS joins FROM fold f JOIN cut c ON c.channel = f.channel AND c.i = f.i + 1) c),
whole AS (SELECT channel, n - 1 AS number, min(ws) AS start_us, max(we) AS end_us FROM fold GROUP BY channel, n),
pieces AS (SELECT f.channel, f.n - c.k + j AS number, c.s + j * 30000000 AS start_us, c.s + (j + 1) * 30000000 AS end_us FROM fold f JOIN (SELECT *, unnest(range(k - 1)) AS j FROM cut WHERE k > 1) c ON c.channel = f.channel AND c.i = f.i),
win AS (SELECT * FROM whole UNION ALL SELECT * FROM pieces)"""
# While a stream runs, its newest united turn is open. Closed are the windows of the turns before it, but for the last one where that turn, as it began, may join it.
CLOSED_SQL = WINDOWS_SQL + """,
newest AS (SELECT channel, max(i) AS i FROM cut GROUP BY channel),
upto AS (SELECT f.channel, max(f.n) AS n, arg_max(f.ws, f.i) AS ws, arg_max(f.we, f.i) AS we FROM fold f JOIN newest USING (channel) WHERE f.i < newest.i GROUP BY f.channel),
begun AS (SELECT c.channel, c.s, arg_min(t.end_us, t.seq) AS e FROM cut c JOIN newest USING (channel, i) JOIN turns t ON t.channel = c.channel AND t.start_us = c.s GROUP BY c.channel, c.s),
shut AS (SELECT channel, CASE WHEN e - s <= 30000000 AND e - ws <= 30000000 AND s - we <= 5000000 THEN n - 1 ELSE n END AS many FROM upto JOIN begun USING (channel)),
closed AS (SELECT win.* FROM win JOIN shut USING (channel) WHERE number < many)"""
PADDED_SQL = f"""WITH RECURSIVE {WINDOWS_SQL},
lim AS (SELECT channel, max(end_us) + 1000000 AS total FROM turns GROUP BY channel), pad AS (SELECT channel, start_us, least(total, end_us + 150000) AS fin FROM win JOIN lim USING (channel))
SELECT channel, greatest(0, start_us - 150000, coalesce(lag(fin) OVER (PARTITION BY channel ORDER BY start_us), 0)) AS start_us, fin AS end_us FROM pad"""
QUERIES = {f.__name__: f for f in (
    sm01_watermarks, sm04_online_windows, sm05_append_only, sm09_sliding_counts, sm11_live_captions, sm09_tail_runs, sm10_bounded_views, sm14_decoded_once,
)}
ORACLE_SQL = {
    "sm04_online_windows": PADDED_SQL,
    "sm09_tail_runs": f"""WITH {EVENTS_SQL}, o AS (SELECT *, CASE WHEN lag(end_us) OVER w IS NULL OR start_us - lag(end_us) OVER w > 1500000 THEN 1 ELSE 0 END AS op FROM words WINDOW w AS (PARTITION BY channel ORDER BY start_us, seq)),
r AS (SELECT *, CAST(sum(op) OVER (PARTITION BY channel ORDER BY start_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM o)
SELECT channel, run, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words, string_agg(text, ' ' ORDER BY start_us, seq) AS text FROM r GROUP BY channel, run""",
    "sm10_bounded_views": f"""WITH RECURSIVE {CLOSED_SQL}
SELECT v.channel, number, v.start_us, v.end_us, greatest(v.start_us - 15000000, 0) AS from_us, count(w.seq) AS n, CAST(coalesce(sum(w.seq % 100), 0) AS DOUBLE) AS total
FROM closed v LEFT JOIN words w ON w.channel = v.channel AND w.start_us >= greatest(v.start_us - 15000000, 0) AND w.start_us < v.end_us GROUP BY ALL""",
    "sm11_live_captions": f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT *, CASE WHEN seq % 4 = 1 THEN 'mic' ELSE 'system' END AS side, row_number() OVER (PARTITION BY channel ORDER BY seq) AS i FROM words),
r AS (SELECT channel, i, 0::BIGINT AS line, side, start_us, end_us, text FROM o WHERE i = 1
  UNION ALL
  SELECT channel, i, CASE WHEN goes THEN line ELSE line + 1 END, side, CASE WHEN goes THEN s0 ELSE start_us END, end_us, CASE WHEN goes THEN t0 || ' ' || text ELSE text END
  FROM (SELECT o.*, r.line, r.start_us AS s0, r.text AS t0, o.side = r.side AND o.start_us - r.end_us <= 1500000 AND length(r.text) < 250 AS goes FROM r JOIN o ON o.channel = r.channel AND o.i = r.i + 1))
SELECT channel, line, arg_max(side, i) AS side, min(start_us) AS start_us, arg_max(end_us, i) AS end_us, arg_max(text, i) AS text FROM r GROUP BY channel, line""",
    "sm14_decoded_once": f"""WITH RECURSIVE {CLOSED_SQL}
SELECT DISTINCT w.channel, w.seq FROM words w JOIN win ON win.channel = w.channel AND w.mid_us >= win.start_us AND w.mid_us < win.end_us
WHERE (w.channel, win.number) IN (SELECT channel, number FROM closed) OR w.channel % 7 = 0 OR w.channel NOT IN (
  SELECT w.channel FROM words w JOIN closed c ON c.channel = w.channel AND w.mid_us >= c.start_us AND w.mid_us < c.end_us)""",
    "sm01_watermarks": f"WITH {EVENTS_SQL} SELECT channel, max(end_us) AS watermark_us, count(*) AS n FROM turns GROUP BY channel",
    "sm05_append_only": f"""WITH {EVENTS_SQL}, u AS (SELECT *, max(start_us) OVER (PARTITION BY channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM words)
SELECT seq, channel, start_us FROM u WHERE latest IS NULL OR start_us + 1 >= latest""",
    "sm09_sliding_counts": """WITH e AS (SELECT event_type AS label, epoch_us(ts) // 3600000000 AS h FROM events), w AS (SELECT label, unnest(range(h - 9, h + 1)) AS s FROM e)
SELECT s * 3600 - 1704067200 AS second, label, count(*) AS n FROM w GROUP BY s, label""",
}
