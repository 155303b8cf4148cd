"""Merkle manifest of a dataset: a hash tree per language, and one over the languages' roots.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its length in UTF-8 bytes, a colon
and the value. The leaves of a language follow one another by id (null ids first; of rows with one
id by leaf). While more than one node remains, every two consecutive ones become the hash of their
hexadecimal digests; a last one without a partner becomes its own hash. What remains is the
language's subroot; subroots in the order of their languages (null first, then by UTF-8 bytes)
become the root likewise.

The tree is built in three steps. Leaves are hashed where the texts are, and only digests move on.
They are numbered by a range partitioning and the counts of its parts, and gathered in blocks of
``2 ** BITS`` consecutive ones, each of which reduces to one node on its own. While more than
``LIMIT`` nodes remain, these are reduced in blocks again. At most ``LIMIT`` nodes reach the driver,
which builds the top of the tree and broadcasts for each node the siblings on its way to the root.
Executors then extend these to each row's whole proof and fold its leaf along it.

Null fields are hashed as such; a null language is a tree of its own. Empty texts are values of
length 0, long ones are hashed whole. Rows that are equal in all fields are leaves of their own,
one after the other, and the number of copies makes no part of the numbering large. Of an empty
table there is no root and no row. Other columns than the hashed ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_chunks, table, written

#: Levels of a block of leaves, nodes that the driver takes, rows of a part of the numbering.
BITS, LIMIT, ROWS_A_PART = 12, 1 << 14, 200_000
#: Rows of (part, language) counts up to which they are broadcast.
FEW = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_UP = "key string, idx long, m long, digest string"
_PATH = "key string, idx long, path string, top string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def parents(nodes: list[str]) -> list[str]:
    """The level above; ``nodes`` starts at an even place of its level."""
    return [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def levels(nodes: list[str], steps: int) -> list[list[str]]:
    """``nodes`` and the ``steps`` levels above."""
    out = [nodes]
    for _ in range(steps):
        out.append(parents(out[-1]))
    return out


def height(n: int) -> int:
    return max(int(n) - 1, 0).bit_length()


def siblings(tree: list[list[str]], at: int) -> str:
    """The digests beside the way up from place ``at`` of the lowest level to the last level, which are left out where there is none."""
    return "".join(level[(at >> k) ^ 1] for k, level in enumerate(tree[:-1]) if (at >> k) ^ 1 < len(level))


def fold(node: str, at: int, n: int, path: str) -> tuple[str, str]:
    """What ``node`` at place ``at`` of ``n`` becomes at the top with the siblings of ``path``, and the rest of ``path``."""
    used = 0
    while n > 1:
        if at ^ 1 < n:
            other = path[used : used + 64]
            used += 64
            node = digest(other + node if at & 1 else node + other)
        else:
            node = digest(node)
        at, n = at >> 1, (n + 1) >> 1
    return node, path[used:]


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields, some of which may be replaced."""
    return F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def numbered(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """``rows`` (with ``key``) with ``idx``, the place among the rows of the key by ``order``, and ``m``, the number of these.

    The parts are ranges, so a key with many rows has many of them; a last order by the row's place in the
    input spreads rows that are equal in ``order``.
    """
    given = written(rows.withColumn("_m", F.monotonically_increasing_id()))
    ranged = given.repartitionByRange(parts, "key", *order, "_m").sortWithinPartitions("key", *order, "_m")
    placed = written(ranged.drop("_m").withColumn("_g", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_g", 33)))
    starts = written(placed.groupBy("key", "_part").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = starts.select("key", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(W.partitionBy("key")).alias("m"))
    joined = placed.join(F.broadcast(offsets) if starts.count() <= FEW else offsets, ["key", "_part"])
    return joined.withColumn("idx", F.col("_g") + F.col("_offset")).drop("_g", "_part", "_offset")


def gathered(nodes: DataFrame, bits: int, *columns: str) -> DataFrame:
    """(key, idx, m, items): blocks of ``2 ** bits`` consecutive nodes at most, in order; ``m`` is still the number of nodes before."""
    items = F.sort_array(F.collect_list(F.struct(F.col("idx").alias("at"), *columns)))
    return nodes.groupBy("key", F.shiftright("idx", bits).alias("block")).agg(F.max("m").alias("m"), items.alias("items")).withColumnRenamed("block", "idx")


def reduced(blocks: DataFrame, bits: int) -> DataFrame:
    """The node that each block becomes, with the number of nodes of the level it is on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tops = [levels([x["digest"] for x in items], min(bits, height(m)))[-1][0] for items, m in zip(pdf["items"], pdf["m"])]
        return pdf[["key", "idx"]].assign(m=[(int(m) + (1 << bits) - 1) >> bits for m in pdf["m"]], digest=tops)

    return map_chunks(blocks.select("key", "idx", "m", "items"), run, _UP, rows=8)


def ways(nodes: DataFrame, bits: int, limit: int) -> tuple[DataFrame, bool]:
    """(key, idx, path, top): for each node of (key, idx, m, digest) the siblings up to its key's top, and that; and whether they came from the driver.

    ``nodes`` is materialised. At most ``limit`` nodes are collected.
    """
    spark = nodes.sparkSession
    few = nodes.limit(limit + 1).collect()
    if len(few) <= limit:
        trees: dict[str, list] = {}
        for r in sorted(few, key=lambda r: (r["key"], r["idx"])):
            trees.setdefault(r["key"], []).append(r["digest"])
        built = {key: levels(tree, height(len(tree))) for key, tree in trees.items()}
        return spark.createDataFrame([(key, at, siblings(tree, at), tree[-1][0]) for key, tree in built.items() for at in range(len(tree[0]))], _PATH), True
    done = nodes.where("m = 1").select("key", "idx", F.lit("").alias("path"), F.col("digest").alias("top"))
    open_ = nodes.where("m > 1")
    if open_.isEmpty():
        return done, False
    blocks = written(gathered(open_, bits, "digest"))
    above, small = ways(written(reduced(blocks, bits)), bits, limit)
    joined = blocks.join(F.broadcast(above) if small else above, ["key", "idx"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, m, items, path, top in zip(pdf["key"], pdf["m"], pdf["items"], pdf["path"], pdf["top"]):
            tree = levels([x["digest"] for x in items], min(bits, height(m)))
            out += [(key, x["at"], siblings(tree, k) + path, top) for k, x in enumerate(items)]
        return pd.DataFrame(out, columns=["key", "idx", "path", "top"])

    return written(done.unionByName(map_chunks(joined.select("key", "m", "items", "path", "top"), run, _PATH, rows=8))), False


def rooted(tops: DataFrame, bits: int, limit: int) -> tuple[DataFrame, bool]:
    """(key, rank, keys, root_path, root) of the materialised (key, top), and whether it came from the driver."""
    few = tops.limit(limit + 1).collect()
    if len(few) <= limit:
        order = sorted((r["key"], r["top"]) for r in few)  # keys are ordered by code points, which is the order of UTF-8 bytes
        tree = levels([top for _, top in order], height(len(order)))
        rows = [(key, k, len(order), siblings(tree, k), tree[-1][0]) for k, (key, _) in enumerate(order)]
        return tops.sparkSession.createDataFrame(rows, "key string, rank long, keys long, root_path string, root string"), True
    parts = 1 + tops.count() // ROWS_A_PART
    ranked = written(numbered(tops.select(F.lit("").alias("key"), F.col("key").alias("name"), "top"), ["name"], parts))
    up, _ = ways(ranked.select("key", "idx", "m", F.col("top").alias("digest")), bits, limit)
    joined = ranked.join(up.select("idx", F.col("path").alias("root_path"), F.col("top").alias("root")), "idx")
    return joined.select(F.col("name").alias("key"), F.col("idx").alias("rank"), F.col("m").alias("keys"), "root_path", "root"), False


def proofs(docs: DataFrame, changed: Column | None = None, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """A row for each of ``docs`` with its leaf, subroot, root, the hash of its proof, the root that ``changed`` (a leaf, or null for the own one) folds to, and whether that is the root."""
    key = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), "lang"))
    changed = F.lit(None).cast("string") if changed is None else changed
    leaves = docs.select(key.alias("key"), "doc_id", leaf().alias("digest"), changed.alias("other"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + docs.count() // ROWS_A_PART)
    blocks = written(gathered(numbered(leaves, ["doc_id", "digest"], parts), bits, "doc_id", "digest", "other"))
    up, small = ways(written(reduced(blocks, bits)), bits, limit)
    tops, few = rooted(up.where("idx = 0").select("key", "top") if small else written(up.where("idx = 0").select("key", "top")), bits, limit)
    joined = blocks.join(F.broadcast(up) if small else up, ["key", "idx"]).join(F.broadcast(tops) if few else tops, "key")

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        for m, items, path, top, rank, keys, root_path, root in pdf.itertuples(index=False):
            nodes = [x["digest"] for x in items]
            tree = levels(nodes, min(bits, height(m)))
            for k, x in enumerate(items):
                whole = siblings(tree, k) + path + root_path
                subroot, rest = fold(x["other"] or x["digest"], x["at"], m, whole)
                folded, _ = fold(subroot, rank, keys, rest)
                yield x["doc_id"], x["digest"], top, root, digest(whole), folded, folded == root

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(rows(pdf)), columns=[c.split()[0] for c in PROOF.split(", ")])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return map_chunks(joined.select("m", "items", "path", "top", "rank", "keys", "root_path", "root"), run, PROOF, rows=1)


def tampered() -> Column:
    """The leaf with one more character counted, where 7 divides the checksum of the id; null where nothing changes."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return F.when(hit, leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents").select(*FIELDS), tampered())


# crc32 is spelled out bit by bit. ``up`` holds every tree by levels: (lang, level, idx, nodes of the level, hash), where the tree over the languages has k = 1.
SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, n_chars, sha256(a || n || t) AS leaf,
    CASE WHEN n_chars IS NOT NULL AND crc % 7 = 0 THEN sha256(a || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || t) ELSE sha256(a || n || t) END AS other
  FROM (SELECT *,
      CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
      CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS n,
      CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS t,
      xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT + 4294967296, 0, 0, 0, 0, 0, 0, 0, 0]))),
        lambda s, x: CASE WHEN x > 0 THEN xor(s, x - 4294967296) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) AS crc
    FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (
  SELECT lang, 0 AS level, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lang, level, idx // 2),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, n, h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2),
way AS (
  SELECT doc_id, p.lang, leaf, p.idx, other AS h, p.n AS n, 0 AS level, false AS over, '' AS path, s.h AS subroot, s.idx AS rank, s.n AS langs
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, w.lang, leaf,
    CASE WHEN w.n = 1 THEN rank ELSE w.idx // 2 END,
    CASE WHEN w.n = 1 THEN w.h WHEN w.idx % 2 = 0 THEN sha256(w.h || coalesce(x.h, '')) ELSE sha256(x.h || w.h) END,
    CASE WHEN w.n = 1 THEN langs ELSE (w.n + 1) // 2 END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, over OR w.n = 1, path || coalesce(x.h, ''), subroot, rank, langs
  FROM way w LEFT JOIN (SELECT lang, level, idx, n, h, false AS k FROM up UNION ALL SELECT NULL, level, idx, n, h, true FROM top) x
    ON w.n > 1 AND x.k = w.over AND (w.over OR x.lang IS NOT DISTINCT FROM w.lang) AND x.level = w.level AND x.idx = xor(w.idx, 1)
  WHERE w.n > 1 OR NOT over)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(path) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified
FROM way WHERE over AND n = 1
"""
