"""Annotations in XML, and the small JSON files beside transcripts: voiceprints and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = "_meeting string, _agent string, _id string, _starttime string, _endtime string, _punc string, _VALUE string"
_MEETING = "_observation string, speaker array<struct<_nxt_agent: string, _channel: string, _global_name: string>>"


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, attributePrefix="_", valueTag="_VALUE", mode="PERMISSIVE").schema(schema).load(path)


def _spoken(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` with start and end as numbers; those without times, or without length, go."""
    timed = rows.withColumn("start", F.expr(f"try_cast({start} as double)")).withColumn("end", F.expr(f"try_cast({end} as double)"))
    return timed.where(F.col("end") > F.col("start"))


def annotated_words(spark: SparkSession, path: str) -> DataFrame:
    """(meeting, agent, id, start, end, text) of the spoken words below a folder. Their meeting and agent are attributes of a word, or else told by folders ``meeting=<m>/agent=<a>`` or by a file's name ``<m>.<a>.words.xml``.

    Only word elements count; marked punctuation, words without times and those without length are left out.
    """
    rows = _xml(spark, path, "w", _WORD)
    file = F.input_file_name()
    part = lambda name, place: F.coalesce(F.nullif(F.regexp_extract(file, f"/{name}=([^/]+)/", 1), F.lit("")), F.regexp_extract(file, "([^/.]+)[.]([^/.]+)[.]words[.]xml$", place))
    named = rows.withColumn("meeting", F.coalesce("_meeting", part("meeting", 1))).withColumn("agent", F.coalesce("_agent", part("agent", 2)))
    marked = F.coalesce(F.col("_punc"), F.lit("")) != ""
    return _spoken(named.where(~marked), "_starttime", "_endtime").select("meeting", "agent", F.col("_id").alias("id"), "start", "end", F.trim("_VALUE").alias("text"))


def write_words(words: DataFrame, path: str) -> None:
    """Words (meeting, agent, id, start, end, punc, text), with null for what is not known, as XML. Meeting and agent are attributes, so that the number of files follows the partitions, not the agents."""
    named = [F.col(c).cast("string").alias(f"_{c}") for c in ("meeting", "agent")]
    as_text = lambda c: F.col(c).cast("string").alias(f"_{c}time")
    rows = words.select(*named, F.col("id").alias("_id"), as_text("start"), as_text("end"), F.when(F.col("punc"), "true").alias("_punc"), F.col("text").alias("_VALUE"))
    rows.write.mode("overwrite").format("xml").options(rowTag="w", rootTag="words", attributePrefix="_", valueTag="_VALUE").save(path)


def meeting_speakers(spark: SparkSession, path: str) -> DataFrame:
    """(meeting, agent, channel, name) of a file of meetings; speakers without an agent, channel or name are left out."""
    rows = _xml(spark, path, "meeting", _MEETING).where("_observation is not null").select(F.col("_observation").alias("meeting"), F.explode("speaker").alias("s"))
    named = rows.select("meeting", F.col("s._nxt_agent").alias("agent"), F.expr("try_cast(s._channel as int)").alias("channel"), F.col("s._global_name").alias("name"))
    return named.where("coalesce(agent, '') <> '' and channel is not null and coalesce(name, '') <> ''")


def transcript_segments(spark: SparkSession, path: str) -> DataFrame:
    """(meeting, participant, channel, file, start, end) of transcripts with channels, participants and segments; only participants with a channel that has a file."""
    tagged = lambda tag, schema: _xml(spark, path, tag, schema).withColumn("meeting", F.regexp_extract(F.input_file_name(), "([^/.]+)[.][^/.]+$", 1))
    channels = tagged("Channel", "_Name string, _AudioFile string").where("_Name <> '' and _AudioFile <> ''").select("meeting", F.col("_Name").alias("channel"), F.col("_AudioFile").alias("file")).distinct()
    people = tagged("Participant", "_Name string, _Channel string").where("_Name <> ''").select("meeting", F.col("_Name").alias("participant"), F.col("_Channel").alias("channel")).distinct()
    said = _spoken(tagged("Segment", "_Participant string, _StartTime string, _EndTime string"), "_StartTime", "_EndTime").withColumnRenamed("_Participant", "participant")
    return said.join(people, ["meeting", "participant"]).join(channels, ["meeting", "channel"]).select("meeting", "participant", "channel", "file", "start", "end")


def write_voiceprints(prints: DataFrame, path: str) -> None:
    """(meeting, model, label, vector) as one JSON object a meeting and model, with a map from labels to vectors."""
    prints.groupBy("meeting", "model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "vector")))).alias("embeddings")).write.mode("overwrite").json(path)


def voiceprints(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_voiceprints`` wrote; meetings without a vector give no row."""
    rows = spark.read.schema("meeting string, model string, embeddings map<string, array<double>>").json(path)
    return rows.select("meeting", "model", F.explode("embeddings").alias("label", "vector"))


def write_trials(trials: DataFrame, path: str) -> None:
    """(name, true_speaker, profile, score) as one JSON object a trial, with a map of scores."""
    trials.groupBy("name", "true_speaker").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("profile", "score")))).alias("scores")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def trials(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_trials`` wrote; a trial without scores has one row with nulls."""
    rows = spark.read.schema("name string, true_speaker string, scores map<string, double>").json(path)
    return rows.select("name", "true_speaker", F.explode_outer("scores").alias("profile", "score"))
