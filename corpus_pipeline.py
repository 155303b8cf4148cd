"""The corpus pipeline: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Documents go whose language cannot be told or is none that was learned,
those that line deduplication leaves without any text, all but one of each near-duplicate group
(and of rows that repeat id and text), and every document with a leaked benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import language, leaks, lines, near, pieces
from parlance.llm.common import ARROW_ROWS, TEXTS, marked, table, without, written

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in no learned language; a null language is filled with the predicted one.

    Short texts and those with few words of letters stay, as they cannot be told; long ones are judged as a whole. Rows that repeat are judged alike. A tie of languages goes to the one that sorts first.
    """
    found = language.predict(docs, language.fit(docs)).where("lang_known")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, and documents of which nothing is left.

    Of similar lines that of the least id (ties: the first in its text, then the least checksum of it) stays. Null and empty texts stay as they are, long ones lose lines like others.
    """
    left = lines.deduplicate_lines(docs)
    blank = F.trim(F.regexp_replace("text", "[\\x09-\\x0D]", " ")) == ""
    kept = left.where((F.col("n_removed") == 0) | ~blank)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group, and one row of those that repeat id and text.

    Rows without an id, and null or empty texts, are linked with nothing and stay. Whole texts are compared, however long.
    """
    others = written(near.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct())
    kept = without(docs, "doc_id", others)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    flagged = marked(kept, "doc_id", repeated)
    once = flagged.where("_marked").dropDuplicates(["doc_id", "text"])
    return flagged.where("not _marked").unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item of at least ``leaks.SHORTEST`` tokens, as shorter phrases stand in clean texts too. Rows are told apart by id and text, so that a null id drops no other row.

    Null and empty texts hold none; long ones are searched to their end; equal rows go or stay together.
    """
    named = docs.withColumn("_stage_row", F.xxhash64("doc_id", "text"))
    leaked = written(leaks.find_leaks(named.select(F.col("_stage_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where(F.col("item_words") >= leaks.SHORTEST).select("doc_id").distinct())
    return without(named, "_stage_row", leaked).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text. A null text is encoded as the empty one, a long one whole; repeated rows each get a row."""
    spark.conf.set(ARROW_ROWS, TEXTS)  # of the session, as the plan is made when the result is written
    encoded = pieces.encode(docs, pieces.model_path())
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else written(docs), sf_dir)
    return docs
