"""How the sources of a language differ in their use of words.

Terms are runs of ASCII letters (lower-cased) and of characters beyond ASCII. A language keeps the
terms that at least ``LEAST_DOCS`` of its documents hold. Every source of the language gives each kept term a
smoothed share in thousand millionths, ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``,
with V kept terms that occur N times in the source, and so does the language. The divergence of two
sources is the sum of the absolute differences of their shares over all kept terms; a source's
terms are those it uses more than its language does.

Each task counts the terms of its documents first. The counts are dealt into shards by the hash of language
and term, so no frequent word is the work of one task, and in every shard DuckDB sums them, keeps terms
and, when the totals of all shards are known, sums differences of pairs of sources and ranks terms.
Spark adds the shards' sums and merges their rankings. Only terms that both sources of a pair hold are
joined: what the pair owes to all others follows from each source's total, from its shares below
the smallest ones of others, and from V. All arithmetic is on integers.

A null text, language or source is the empty string. A source without any term takes part with
counts of 0. Texts are read whole. Ties are ranked by the item's UTF-8 bytes; repeated rows count
each time. Without kept terms all divergences are 0. An empty table gives no rows. Columns other
than text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import _cuts, table, written

LEAST_DOCS, SCALE, SMOOTH, TOP = 30, 1_000_000_000, 5, 50
#: Documents and bytes that are counted together, documents a shard, groups of (lang, source) up to which their totals are broadcast.
ROWS, BYTES, DOCS_A_SHARD, FEW = 1 << 15, 1 << 25, 20_000, 100_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of some texts without nulls, and the place of each one's text."""
    texts = pa.array(texts, pa.string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    inside = _LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = (ends[:-1] - ends[0])[np.diff(ends) > 0]
    first[heads] = inside[heads]  # a text's first letter starts a term, whatever the text before it ends with
    starts = np.flatnonzero(first)
    cuts = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(_LOWER[data[inside]]))
    return words, np.searchsorted(ends - ends[0], starts, side="right") - 1


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, term, source, n, docs) of some documents (lang, source, text without nulls): occurrences, and documents that hold the term."""
    words, doc = terms(batch.column("text"))
    words = words.dictionary_encode()
    code, many = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    held, times = np.unique(doc * many + code, return_counts=True)  # each document's terms
    found, back = np.unique(group[held // many] * many + held % many, return_inverse=True)
    of = found // many
    return pa.RecordBatch.from_pydict({
        "lang": lang.dictionary.take(pa.array(of // len(source.dictionary) if len(of) else of)), "term": words.dictionary.take(pa.array(found % many)),
        "source": source.dictionary.take(pa.array(of % len(source.dictionary) if len(of) else of)),
        "n": pa.array(np.bincount(back, weights=times, minlength=len(found)).astype(np.int64)), "docs": pa.array(np.bincount(back, minlength=len(found)).astype(np.int64)),
    })


def term_counts(docs: DataFrame) -> DataFrame:
    """``counted`` of all documents in runs of a few thousand; the counts of one term are still in many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pairwise(_cuts(batch, ROWS, BYTES)):
                if to > at:
                    yield counted(batch.slice(at, to - at))

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, term string, source string, n long, docs long")


def in_duckdb(rows: DataFrame, load: str, sql: str, ddl: str) -> DataFrame:
    """``sql`` over each partition of ``rows``: ``load`` makes its table ``shard`` from the rows, which are ``given``."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        with duckdb.connect(config={"threads": 1}) as con:
            con.register("given", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
            con.execute(f"CREATE TABLE shard AS {load}")
            for batch in con.sql(sql).to_arrow_reader(1 << 14):
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(batch.columns, schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, sources, counts), a row for each kept term of a language."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + docs.count() // DOCS_A_SHARD)
    return written(in_duckdb(
        term_counts(docs).repartition(parts, "lang", "term"),
        "SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM given GROUP BY ALL",
        f"SELECT lang, term, sum(n)::BIGINT AS total, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts FROM shard GROUP BY lang, term HAVING sum(docs) >= {int(least_docs)}",
        "lang string, term string, total long, sources array<string>, counts array<long>",
    ))


def share(count: str, occurrences: str) -> Column:
    """A smoothed share in thousand millionths, by whole division of wide integers; 0 where no terms are kept."""
    return F.expr(f"if(v = 0, 0, 1 + cast({SCALE} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(19,0)) div cast({occurrences} + {SMOOTH} * v as decimal(19,0)))").cast("long")


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, v, n, all_n, zero, ceiling) of every group: kept terms, their occurrences in the group and in the language, the group's share of an absent term, and the largest such share in the language."""
    groups = docs.select("lang", "source").distinct()
    own = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all_n"))
    joined = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    filled = joined.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "n", "all_n")]).withColumn("zero", share("0", "n"))
    return written(filled.withColumn("ceiling", F.max("zero").over(W.partitionBy("lang"))))


#: Per shard: what the terms that both sources hold add to a pair, each source's sum and number of shares, its shares below the ceiling, and its first terms.
SHARD_SQL = f"""
SELECT 'pair' AS part, a.lang AS lang, a.source AS source, b.source AS item,
  sum(abs(a.p - b.p) - abs(a.p - b.zero) - abs(a.zero - b.p) + abs(a.zero - b.zero))::BIGINT AS value, 0::BIGINT AS n
FROM shard a JOIN shard b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL
SELECT 'sum', lang, source, '', sum(p)::BIGINT, count(*)::BIGINT FROM shard GROUP BY ALL
UNION ALL
SELECT 'low', lang, source, '', p, count(*)::BIGINT FROM shard WHERE p < ceiling GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, p - q, 0::BIGINT FROM shard WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {TOP}
"""


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source all others of its language (part ``pair``) and its ``TOP`` own terms (``term``)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = kept_terms(docs, least_docs)
    groups = totals(docs, kept)
    small = groups.count() <= FEW
    held = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("c"))
    shares = held.join(F.broadcast(groups) if small else groups, ["lang", "source"]).select(
        "lang", "term", "source", "zero", "ceiling", share("c", "n").alias("p"), share("total", "all_n").alias("q")
    )
    if not small:  # the join has dealt the rows by source
        shares = shares.repartition("lang", "term")
    found = written(in_duckdb(shares, "SELECT * FROM given", SHARD_SQL, "part string, lang string, source string, item string, value long, n long"))

    zeros = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    sums = groups.join(found.where("part = 'sum'").groupBy("lang", "source").agg(F.sum("value").alias("p"), F.sum("n").alias("held")), ["lang", "source"], "left")
    sums = sums.select("lang", "source", "v", "zero", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p", "held")])
    low = found.where("part = 'low'").groupBy("lang", "source", F.col("value").alias("share")).agg(F.sum("n").alias("times"))
    under = low.join(zeros, (low["lang"] == zeros["lang"]) & (F.col("share") < F.col("other_zero")) & (F.col("source") != F.col("item")))
    under = under.groupBy(low["lang"].alias("lang"), "source", "item").agg(F.sum((F.col("other_zero") - F.col("share")) * F.col("times")).alias("below"))
    both = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("both"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    # From one side: the shares of a source against the other's share of an absent term.
    other = sums.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("p").alias("other_p"), F.col("held").alias("other_held"))
    pairs = sums.join(other, "lang").where("source <> item").join(under, ["lang", "source", "item"], "left")
    pairs = pairs.join(under.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("below").alias("other_below")), ["lang", "source", "item"], "left")
    value = (
        "p - held * other_zero + 2 * coalesce(below, 0) + other_p - other_held * zero + 2 * coalesce(other_below, 0)"
        " + (v - held - other_held) * abs(zero - other_zero) + coalesce(both, 0)"
    )
    pairs = pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(value).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    # Ranked by itself, so that each task keeps its first terms only and no group grows with the number of shards.
    first = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(first)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, total, count(*) OVER w AS v, sum(coalesce(c, 0)) OVER w AS n, sum(total) OVER w AS all_n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
  WINDOW w AS (PARTITION BY g.lang, g.source)),
shares AS (SELECT lang, source, term, c, 1 + ({SCALE}::HUGEINT * (c + {SMOOTH})) // (n + {SMOOTH} * v) AS p, 1 + ({SCALE}::HUGEINT * (total + {SMOOTH})) // (all_n + {SMOOTH} * v) AS q FROM dense),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
QUALIFY part = 'pair' OR rank <= {TOP}
"""
