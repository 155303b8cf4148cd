"""Timed records derived from the driver's tables, in whole microseconds, and the same as SQL.

``words`` are the events with odd ids and ``turns`` those with even ids; a channel is a user. Time
runs ``SCALE`` times slower than in the table, so that words and turns overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 36_000
WORD_US = 300_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = f"(unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')) div {SCALE}"
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("channel"), F.expr(start).alias("start_us"), "event_type", "value")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, channel, text, start_us, end_us, mid_us)"""
    rows = _events(spark, sf_dir).where("event_id % 2 = 1")
    return rows.select(
        F.col("event_id").alias("seq"), "channel", F.col("event_type").alias("text"), "start_us",
        (F.col("start_us") + WORD_US).alias("end_us"), (F.col("start_us") + WORD_US // 2).alias("mid_us"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, channel, speaker, start_us, end_us)"""
    rows = _events(spark, sf_dir).where("event_id % 2 = 0")
    length = F.floor(F.least(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.1)), F.lit(30.0)) * 100000).cast("long")
    return rows.select(F.col("event_id").alias("seq"), "channel", F.col("event_type").alias("speaker"), "start_us", (F.col("start_us") + length).alias("end_us"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript entries from ``conversations``: (meeting, seq, speaker, text, start_us, end_us), 15 characters a second."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    length = (F.char_length("text") * 1_000_000).cast("long")
    end = F.sum(length).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow))
    timed = rows.withColumn("_end", end).withColumn("_len", length)
    return timed.select(
        F.col("conv_id").alias("meeting"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text",
        F.expr("(_end - _len) div 15").alias("start_us"), F.expr("_end div 15").alias("end_us"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


EVENTS_SQL = f"""ev AS (SELECT event_id, user_id AS channel, (epoch_us(ts) - 1704067200000000) // {SCALE} AS start_us, event_type, value FROM events),
words AS (SELECT event_id AS seq, channel, event_type AS text, start_us, start_us + {WORD_US} AS end_us, start_us + {WORD_US // 2} AS mid_us FROM ev WHERE event_id % 2 = 1),
turns AS (SELECT event_id AS seq, channel, event_type AS speaker, start_us, start_us + CAST(floor(least(greatest(coalesce(value, 0.0), 0.1), 30.0) * 100000) AS BIGINT) AS end_us FROM ev WHERE event_id % 2 = 0)"""
ENTRIES_SQL = """timed AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) * 1000000 AS len,
  CAST(sum(length(coalesce(text, '')) * 1000000) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM conversations),
entries AS (SELECT conv_id AS meeting, turn AS seq, role AS speaker, text, (fin - len) // 15 AS start_us, fin // 15 AS end_us FROM timed)"""
