"""Document fingerprints: the bottom-k sketch of a text's shingle hashes.

A shingle is a run of five lower-cased words (the whole text if it has fewer); its hash has 48
bits. A fingerprint holds the ``K`` least distinct hashes in ascending order. Fingerprints of
parts merge into that of the whole, and estimate resemblance, containment and the number of
distinct shingles; with fewer than ``K`` shingles the estimates are exact.

Everything is built-in column functions. Null texts count as empty; texts without words have an
empty fingerprint, and two empty fingerprints are fully alike. Equal texts have equal
fingerprints. Repeated rows each get a row. Extra columns of the input are not read. Ids may be
any integers: the order by id is cut where a sample of the rows says, not by arithmetic on ids, so
that neither gaps nor clusters of ids nor a repeated id fill one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

WORDS, K, DIGITS = 5, 128, 12
HASH_RANGE = float(1 << 48)
#: Ranges of the order by id: four for each shuffle partition and one for each ``ROWS_A_PART`` rows, within these bounds; sampled rows for each.
LEAST_PARTS, MOST_PARTS, ROWS_A_PART, SAMPLE_A_PART = 512, 1 << 14, 4096, 64


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text as an array of long."""
    words, hashes, n = f"_w_{name}", f"_h_{name}", f"_n_{name}"
    step = df.withColumn(words, F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D]", " ")), " +"))
    step = step.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).withColumn(n, F.size(hashes))
    run = f"shiftrightunsigned(xxhash64(x, {', '.join(f'get({hashes}, i + {j})' for j in range(1, WORDS))}), 16)"
    shingles = F.expr(
        f"case when {n} >= {WORDS} then transform(slice({hashes}, 1, {n} - {WORDS - 1}), (x, i) -> {run}) "
        f"when {n} = 1 and {words}[0] = '' then cast(array() as array<bigint>) else array(shiftrightunsigned(xxhash64({hashes}), 16)) end"
    )
    return step.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, K)).drop(words, hashes, n)


def merge(a: Column, b: Column) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, K)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of the union's least hashes that both have."""
    union = merge(a, b)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column) -> Column:
    """Estimated number of distinct shingles."""
    return F.when(F.size(a) < K, F.size(a).cast("double")).otherwise((K - 1) * HASH_RANGE / F.element_at(a, K))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too."""
    joint = resemblance(a, b) * distinct_shingles(merge(a, b))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), joint / distinct_shingles(a)))


def merged_by(df: DataFrame, keys: list[str], fingerprint: str, salts: int = 64) -> DataFrame:
    """The fingerprint of each group's rows together. Hashes are reduced within salted parts of a group first, so a hot group is spread."""
    rows = df.select(*keys, F.explode(fingerprint).alias("_hash"))
    rows = rows.groupBy(*keys, "_hash").agg(F.lit(1).alias("_one")).withColumn("_salt", F.pmod("_hash", F.lit(salts)))
    parts = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy("_hash"))).where(F.col("_rank") <= K)
    return parts.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_hash")), 1, K).alias(fingerprint))


def as_text(a: Column) -> Column:
    """Hexadecimal digits, ``DIGITS`` for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def range_starts(docs: DataFrame) -> list[tuple[int, int]]:
    """Rows (id, hash of the text) that cut the order by descending id into ranges of like size, from a bounded sample."""
    n = docs.count()
    parts = max(LEAST_PARTS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, n // ROWS_A_PART))
    rows = docs.sample(min(1.0, SAMPLE_A_PART * parts / max(n, 1)), seed=1).select("doc_id", "_h").collect()  # about SAMPLE_A_PART * parts rows of two numbers
    rows = sorted({(-r["doc_id"], r["_h"]) for r in rows})
    step = max(1, -(-len(rows) // parts))
    return [(-i, h) for i, h in rows[step::step]]


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, _h) in groups such that a window by ``_copy``, descending id and ``_h`` leads to the next document.

    The rows in order are cut into ranges; each range also gets the first row of the one after it
    (flag ``_copy``; after the last range comes the first), so that no row needs a neighbour of
    another range.
    """
    starts = range_starts(docs)
    ids, hashes = (F.lit([x[k] for x in starts]) if starts else F.array().cast("array<bigint>") for k in (0, 1))
    steps = [1 << k for k in reversed(range(len(starts).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        """Binary search: past ``step`` more starts, if the last of them does not come after the row."""
        i = at + step - 1
        after = (F.get(ids, i) < F.col("doc_id")) | ((F.get(ids, i) == F.col("doc_id")) & (F.get(hashes, i) > F.col("_h")))
        return F.when((i < len(starts)) & ~after, at + step).otherwise(at)

    bucket = F.aggregate(F.lit(steps), F.lit(0), further) if steps else F.lit(0)
    placed = docs.withColumn("_bucket", bucket)
    firsts = placed.groupBy("_bucket").agg(F.max(F.struct("doc_id", (-F.shiftright("_h", 1)).alias("g"))).alias("x")).collect()  # one row a range
    order = sorted((r["_bucket"], r["x"]["doc_id"], -r["x"]["g"]) for r in firsts)
    per_range = {b: (order[k - 1][0], i, g) for k, (b, i, g) in enumerate(order)}
    earlier, first_id, first_g = (F.lit([per_range.get(b, (0, 0, 0))[k] for b in range(len(starts) + 1)])[F.col("_bucket")] for k in range(3))
    first = (F.col("doc_id") == first_id) & (F.shiftright("_h", 1) == first_g)
    copy = F.when(first, F.struct(earlier.alias("b"), F.lit(True).alias("c")))
    places = F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("c")), copy))
    return placed.select("doc_id", "text", "_h", F.explode(places).alias("p")).select("doc_id", "text", "_h", F.col("p.b").alias("_bucket"), F.col("p.c").alias("_copy"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and that to the next document's.

    Documents follow one another by descending id; of those with one id the order is that of a hash
    of their texts. A row without an id has no place in this order; its next document is the first.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    high, without = docs.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).head()
    order = W.partitionBy("_bucket").orderBy("_copy", F.desc("doc_id"), "_h")
    half = "cast(floor(char_length(text) / 2) as int)"

    def compared(rows: DataFrame, after) -> DataFrame:
        """``rows`` has the next document's text as ``_next``; ``after`` adds its fingerprint as ``_after``."""
        edited = f"case when {half} > 0 then concat(substring(text, 1, char_length(text) - {half}), substring(_next, 1, {half})) else text end"
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_edited", F.expr(edited)).withColumn("edited_sha256", F.sha2("_edited", 256))
        rows = with_fingerprint(with_fingerprint(rows, F.col("text"), "_own"), F.col("_edited"), "_changed").drop("_edited", "text")
        return after(rows).select(
            "doc_id", "n_chars", "edited_sha256", as_text(F.col("_own")).alias("fingerprint"), as_text(F.col("_changed")).alias("edited_fingerprint"),
            resemblance(F.col("_own"), F.col("_changed")).alias("near_edited"), resemblance(F.col("_own"), F.col("_after")).alias("near_next"),
            containment(F.col("_own"), F.col("_changed")).alias("contained_in_edited"), distinct_shingles(F.col("_own")).alias("distinct_shingles"),
        )

    parts = []
    if high is not None:
        rows = with_neighbours(docs.where("doc_id is not null")).withColumn("_next", F.lead("text").over(order))
        parts.append(compared(rows, lambda r: r.withColumn("_after", F.lead("_own").over(order)).where("not _copy")))
    if without or high is None:
        first = "" if high is None else docs.where(F.col("doc_id") == high).agg(F.min_by("text", "_h")).head()[0]
        rows = docs.where("doc_id is null").withColumn("_next", F.lit(first))
        parts.append(compared(rows, lambda r: with_fingerprint(r, F.col("_next"), "_after")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
