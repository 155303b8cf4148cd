"""Transcripts in files: JSON in and out, and text, Markdown and subtitle sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clock, escape_vtt, subtitle_time, wrap
from ..operators.windows import cues

VERSION = 1
WORD = "struct<text: string, start: double, end: double, confidence: double>"
SCHEMA = f"version int, language string, profile string, entries array<struct<speaker: string, text: string, start: double, end: double, provisional: boolean, words: array<{WORD}>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript documents with their path. A missing version reads as 1; a newer one fails; unknown keys are ignored."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    version = F.coalesce("version", F.lit(VERSION))
    message = F.concat(F.lit("transcript version "), version.cast("string"), F.lit(" is newer than this library reads"))
    return rows.withColumn("version", F.when(version > VERSION, F.raise_error(message).cast("int")).otherwise(version))


def write_transcripts(docs: DataFrame, path: str, force: bool = False) -> None:
    docs.drop("path").write.mode("overwrite" if force else "errorifexists").json(path)


def latest_meeting(folders: DataFrame) -> DataFrame:
    """The folder with the greatest name among (name, has_transcript)."""
    return folders.where("has_transcript").orderBy(F.desc("name")).limit(1)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a glossary file: comments after # and blank lines are dropped."""
    term = F.trim(F.split("value", "#")[0])
    return spark.read.text(path).select(term.alias("term")).where("term <> ''")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """(file, channel, start, end, speaker) of SPEAKER lines with positive length; short lines fail."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(;;|#)") & (F.trim("value") != ""))
    turns = lines.where(parts[0] == "SPEAKER").select(parts.alias("p"))
    checked = turns.withColumn("p", F.when(F.size("p") < 8, F.raise_error(F.lit("a SPEAKER line has fewer than 8 fields")).cast("array<string>")).otherwise(F.col("p")))
    start, length = F.col("p")[3].cast("double"), F.col("p")[4].cast("double")
    return checked.select(F.col("p")[1].alias("file"), F.col("p")[2].alias("channel"), start.alias("start"), (start + length).alias("end"), F.col("p")[7].alias("speaker")).where(length > 0)


def write_rttm(turns: DataFrame, path: str) -> None:
    line = F.format_string("SPEAKER %s %s %.3f %.3f <NA> <NA> %s <NA> <NA>", "file", "channel", "start", F.col("end") - F.col("start"), "speaker")
    turns.select(line.alias("value")).write.text(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated utterances whose last two columns are JSON lists."""
    rows = spark.read.csv(path, sep="\t", schema="uttid string, text string, rare string, biasing string", quote="")
    lists = [F.from_json(c, "array<string>").alias(f"{c}_words") for c in ("rare", "biasing")]
    return rows.select("uttid", "text", *lists)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; an id that appears twice fails."""
    rows = spark.read.schema("id string, source string, start double, end double, language string, notes string, channel string").option("multiLine", True).json(path)
    n = F.count(F.lit(1)).over(W.partitionBy("id"))
    return rows.withColumn("_n", n).withColumn("id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated id "), "id")).cast("string")).otherwise(F.col("id"))).drop("_n")


def upgraded_profiles(rows: DataFrame) -> DataFrame:
    """Profiles of both versions: a single ``embedding`` becomes one undated entry."""
    one = F.array(F.struct(F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("date")))
    return rows.select("name", "embedding_model", F.coalesce("embeddings", F.when(F.col("embedding").isNotNull(), one)).alias("embeddings"))


def in_order(entries: DataFrame, key: str, line: Column, between: str) -> DataFrame:
    """One text per key: its lines by start, end and seq."""
    lines = entries.select(key, F.struct("start_us", "end_us", "seq", line.alias("line")).alias("x"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), between).alias("text"))


def markdown(entries: DataFrame, key: str = "meeting") -> DataFrame:
    overlap = F.when(F.coalesce("provisional", F.lit(False)), " *(overlap)*").otherwise("")
    return in_order(entries, key, F.concat(F.lit("**"), "speaker", F.lit("** ["), clock(F.col("start_us")), F.lit("]"), overlap, F.lit(": "), "text"), "\n\n")


def plain(entries: DataFrame, key: str = "meeting") -> DataFrame:
    return in_order(entries, key, F.concat("speaker", F.lit(": "), "text"), "\n")


def json_documents(entries: DataFrame, key: str = "meeting", about: DataFrame | None = None) -> DataFrame:
    """One JSON text per key: version, what ``about`` (key and, say, language, profile and parameters) tells, and the entries in order, with ``provisional`` and words ``ws`` where there are such columns. Unknown values are null."""
    held = [c for c in ("provisional", "ws") if c in entries.columns]
    rows = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_us", "end_us", "seq", "speaker", "text", *held))).alias("entries"))
    told: list[str] = []
    if about is not None:
        told = [c for c in about.columns if c != key]
        rows = rows.join(about, key, "left")
    return rows.select(key, F.to_json(F.struct(F.lit(VERSION).alias("version"), *told, "entries"), {"ignoreNullFields": "false"}).alias("text"))


def subtitle_cues(entries: DataFrame, key: str = "meeting") -> DataFrame:
    """(key, speaker, start_us, end_us, seq, text) of short cues, in order of start and end.

    Entries (key, seq, speaker, text, start_us, end_us) with an array ``ws`` of timed words are cut
    into cues; one without words, or a table without that column, gives one cue over its span.
    """
    whole = entries
    if "ws" in entries.columns:
        timed = F.coalesce(F.size("ws"), F.lit(0)) > 0
        whole = entries.where(~timed)
    made = whole.select(key, "speaker", "start_us", "end_us", F.col("seq").alias("_entry"), F.lit(0).alias("_cue"), "text")
    if "ws" in entries.columns:
        cut = cues(entries.where(timed).select(key, F.col("seq").alias("_entry"), "speaker", "ws"), [key, "_entry"])
        made = made.unionByName(cut.select(key, "speaker", "start_us", "end_us", "_entry", F.col("seq").alias("_cue"), "text"))
    number = F.row_number().over(W.partitionBy(key).orderBy("start_us", "end_us", "_entry", "_cue"))
    return made.withColumn("seq", number).drop("_entry", "_cue")


def srt(entries: DataFrame, key: str = "meeting") -> DataFrame:
    times = F.concat(subtitle_time(F.col("start_us"), ","), F.lit(" --> "), subtitle_time(F.col("end_us"), ","))
    body = wrap(F.concat("speaker", F.lit(": "), "text"))
    return in_order(subtitle_cues(entries, key), key, F.concat(F.col("seq").cast("string"), F.lit("\n"), times, F.lit("\n"), body, F.lit("\n")), "\n")


def vtt(entries: DataFrame, key: str = "meeting") -> DataFrame:
    times = F.concat(subtitle_time(F.col("start_us"), "."), F.lit(" --> "), subtitle_time(F.col("end_us"), "."))
    body = F.concat(F.lit("<v "), escape_vtt(F.col("speaker")), F.lit(">"), wrap(escape_vtt(F.col("text"))), F.lit("</v>"))
    made = in_order(subtitle_cues(entries, key), key, F.concat(times, F.lit("\n"), body, F.lit("\n")), "\n")
    return made.withColumn("text", F.concat(F.lit("WEBVTT\n\n"), "text"))


FORMATS = {"md": markdown, "txt": plain, "json": json_documents, "srt": srt, "vtt": vtt}


def render(entries: DataFrame, formats: list[str] = ("md", "json", "txt"), key: str = "meeting") -> dict[str, DataFrame]:
    """A DataFrame of texts per format; an unknown format is a KeyError."""
    return {f: FORMATS[f](entries, key) for f in formats}


def free_names(rows: DataFrame, base: str, between: str = "-", after: str = "") -> DataFrame:
    """``name``: base for the first of equals, then base-2, base-3 by ``seq``."""
    n = F.row_number().over(W.partitionBy(base).orderBy("seq"))
    return rows.withColumn("name", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(between), n.cast("string"), F.lit(after))))
