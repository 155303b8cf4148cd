"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits. A mask keeps some positions of a short span
and ignores the others; the kept tokens at every position of documents and benchmark items are
hashed, and equal hashes are hits. A hit fixes an alignment; along it the item is compared with
the document token by token, and the pair is a leak if some run of ``WINDOW`` aligned positions
(the whole item if it is shorter) agrees in at least ``PERCENT`` of them. So substituted tokens
are tolerated both by the masks and by the check.

The two masks of weight six meet every 13 tokens of which two are substituted. Items of fewer than
``WINDOW`` tokens have two masks of weight four instead, which meet every item of 8 tokens or more
that agrees in enough of them; those masks are only laid on the documents if there are such items.
An item of fewer than 8 tokens must be quoted whole; one of fewer than ``SHORTEST`` is met by the hash of all its
tokens, and its rows show by ``item_words`` that little was quoted: such phrases stand in clean texts too.

Everything is built-in column functions. The seeds of the benchmark are broadcast only while
their number is at most ``BROADCAST``; beyond that a bitmap of fixed size lets through the positions that may hit, and
only these are joined by a shuffle. Only texts with a hit are shuffled. Null and empty texts and items match nothing. Equal items count as one, under
their least id. Rows that repeat an id give one leak per item; rows with a null id are found under
the null id, and are told apart by their texts. Extra columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, table, written

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
#: By the number of tokens of an item that is too short for these.
TINY_MASKS = {1: (0,), 2: (0, 1), 3: (0, 1, 2)}
WINDOW, PERCENT, WHOLE, SHORTEST = 13, 80, 8, 4
BROADCAST = 500_000


def tokens(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def with_seeds(df: DataFrame, words: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A row per position and mask that fits: ``seed`` and ``at``; the other columns but ``words`` stay."""
    kept = [c for c in df.columns if c != words]
    hashed = df.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    sized = hashed.select(*kept, "_h", F.size("_h").alias("_n"))
    per_mask, before, at = [], "0", ""
    for mask in masks:
        fits = f"greatest(0, _n - {mask[-1]})"
        parts = [str(j) for j in mask[1:]] + ["x"] + [f"get(_h, i + {j})" for j in mask[1:]]
        per_mask.append(F.expr(f"transform(slice(_h, 1, {fits}), (x, i) -> xxhash64({', '.join(parts)}))"))
        at += f" when _pos < {before} + {fits} then _pos - ({before})"
        before += f" + {fits}"
    seeds = sized.select(*kept, "_n", F.posexplode(F.concat(*per_mask)).alias("_pos", "seed"))
    return seeds.select(*kept, "seed", F.expr(f"case{at} end").alias("at"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items as (item_id, item_words)."""
    words = benchmark.select("item_id", F.filter(tokens(F.col("text")), lambda w: w != "").alias("item_words"))
    return words.where(F.size("item_words") > 0).groupBy("item_words").agg(F.min("item_id").alias("item_id")).select("item_id", "item_words")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, matched, best) of every leaked item: tokens of the item, equal tokens on the best alignment, and in its best run."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    items = items_of(benchmark)
    n = F.size("item_words")
    count, sizes = items.agg(F.coalesce(F.sum(n), F.lit(0)), F.collect_set(F.when(n < WINDOW, n))).head()  # at most WINDOW - 1 sizes
    kinds = [(n >= WINDOW, MASKS)]
    if any(k >= SHORTEST for k in sizes):
        kinds.append((n.between(SHORTEST, WINDOW - 1), SHORT_MASKS))
    kinds += [(n == k, (TINY_MASKS[k],)) for k in sorted(sizes) if k < SHORTEST]
    few = count * len(MASKS) <= BROADCAST
    sized = F.broadcast if few else (lambda df: df)
    seeds = with_seeds(items.where(kinds[0][0]), "item_words", kinds[0][1])
    for which, masks in kinds[1:]:
        seeds = seeds.unionByName(with_seeds(items.where(which), "item_words", masks))
    places = with_seeds(docs.select("doc_id", "_row", tokens(F.col("text")).alias("words")), "words", tuple(m for _, masks in kinds for m in masks))
    if not few:
        seeds = written(seeds)
        places = marked(places, "seed", seeds.select("seed")).where("_marked").drop("_marked")
    hits = places.join(sized(seeds.withColumnRenamed("at", "item_at")), "seed")
    aligned = written(hits.select("doc_id", "_row", "item_id", (F.col("at") - F.col("item_at")).alias("offset")).distinct())
    texts = marked(docs, "_row", aligned.select("_row")).where("_marked").select("_row", "text").dropDuplicates(["_row"])
    pairs = aligned.join(texts.select("_row", tokens(F.col("text")).alias("words")), "_row").join(sized(items), "item_id")
    same = pairs.withColumn("same", F.expr("transform(item_words, (w, i) -> int(coalesce(get(words, i + offset) = w, false)))"))
    runs = same.withColumn("run", F.least(F.lit(WINDOW), n)).withColumn(
        "best", F.expr("array_max(transform(sequence(0, size(same) - run), s -> aggregate(slice(same, s + 1, run), 0, (a, x) -> a + x)))")
    )
    least = F.when(n < WHOLE, 100).otherwise(PERCENT)
    leaks = runs.where(100 * F.col("best") >= least * F.col("run")).select(
        "doc_id", "item_id", n.alias("item_words"), F.struct(F.expr("aggregate(same, 0, (a, x) -> a + x)").alias("matched"), "best").alias("s")
    )
    return leaks.groupBy("doc_id", "item_id", "item_words").agg(F.max("s").alias("s")).select("doc_id", "item_id", "item_words", "s.matched", "s.best")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
