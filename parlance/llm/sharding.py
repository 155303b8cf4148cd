"""Sharding by a Feistel permutation of global row numbers.

Every row gets a number from 0 to N-1; a keyed Feistel network with cycle walking permutes
0..N-1; position p goes to shard ``p % shards``, slot ``p // shards``. Shard sizes differ by
at most one row, slots have no gaps, and both directions of the map can be computed from the
row number, the seed and N alone.

Row numbers follow a seeded hash of (id, size, checksum), so that no pattern of ids makes a
range of numbers hot. Equal rows are counted before the shuffle and numbered by expanding the
count, in stretches of ``STRETCH`` so that many copies of a row are the work of many tasks. The
number of ranges grows with the table. The text itself never moves: only id, size and checksum do.

Null ids, null texts (size 8, checksum of the empty string), repeated rows and empty tables
are handled; each input row gives one output row. Clashing extra columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, table

SEED, ROUNDS, STRETCH = 20, 6, 1 << 16


def _round_keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, int(n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _network(x: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    """One pass over the domain of 2**bits; the two halves are modified in turn."""
    low_bits, high_bits = _halves(n)
    low_mask, high_mask = np.uint64((1 << low_bits) - 1), np.uint64((1 << high_bits) - 1)
    high, low = x >> np.uint64(low_bits), x & low_mask
    keys = list(enumerate(_round_keys(seed)))
    for i, key in reversed(keys) if inverse else keys:
        if i % 2:
            high = high ^ (mix(low + key) & high_mask)
        else:
            low = low ^ (mix(high + key) & low_mask)
    return (high << np.uint64(low_bits)) | low


def permute(x: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1: values that leave the range walk on until they return."""
    out = _network(x.astype(np.uint64), n, seed, inverse)
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = _network(out[outside], n, seed, inverse)
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def locate(row_number: np.ndarray, n: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of a row number."""
    p = permute(np.asarray(row_number), n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = SEED) -> np.ndarray:
    """The row number that holds a shard's slot."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, inverse=True)


def bucket_bits(n: int) -> int:
    """Ranges of about 2**17 rows: 2**10 at least, and 2**14 at most, so that their counts stay few."""
    return min(14, max(10, (n >> 17).bit_length()))


def number_rows(rows: DataFrame, seed: int = SEED) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_number`` from 0, and their count."""
    names = rows.columns
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in names])
    bits = bucket_bits(rows.count())
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", key)
    counted = counted.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    sizes = dict(counted.groupBy("_b").agg(F.sum("_n")).collect())  # 2**bits rows at most
    per_bucket = [sizes.get(b, 0) for b in range(1 << bits)]
    before = [0, *accumulate(per_bucket)]
    order = W.partitionBy("_b").orderBy("_h", *names).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.sum("_n").over(order) + F.element_at(F.lit(before), F.col("_b") + 1)
    numbered = counted.select(*names, (last - F.col("_n")).alias("_from"), last.alias("_to"))
    stretches = numbered.select(*names, "_to", F.explode(F.sequence("_from", F.col("_to") - 1, F.lit(STRETCH))).alias("_at"))
    once = (F.col("_to") - F.col("_at")) == 1
    spread = stretches.where(~once).repartition("_at")
    each = F.explode(F.sequence("_at", F.least(F.col("_at") + STRETCH, F.col("_to")) - 1)).alias("row_number")
    return stretches.where(once).select(*names, F.col("_at").alias("row_number")).unionByName(spread.select(*names, each)), before[-1]


def shard(docs: DataFrame, shards: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document, with its size and checksum."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, seed)

    @F.pandas_udf("long")
    def position(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    p = F.col("_p")
    return numbered.withColumn("_p", position("row_number")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (p % shards).cast("int").alias("shard"), F.floor(p / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 24)
