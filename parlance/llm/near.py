"""Near-duplicate documents by MinHash.

A document's set holds its distinct runs of ``words`` lower-cased words; with fewer words, the
whole sequence is one shingle. Two documents are linked if the Jaccard similarity of their sets
is at least ``percent`` / 100, checked on the full sets in integers. Many universal hash minima
are banded, four to a band; a pair exactly at the threshold shares no band with a chance of
under one in a million. Documents with equal sets are one class from the start, and only one
document of a class is banded, so copies cost nothing more however many there are. Components
come from alternating large-star and small-star.

Null and empty texts, and texts without words, have an empty set and are linked with nothing.
A row with a null id is linked with nothing and is kept. Rows that repeat an id with equal text
are one class. Extra columns of the input are carried through or not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import link, sized
from .common import TEXTS, cut, map_chunks, mix, shingle_hashes, table, word_hashes

ROWS = 4


def bands_for(percent: int) -> int:
    """Bands such that a pair at the threshold is missed with a chance under 1e-6."""
    return math.ceil(math.log(1e-6) / math.log(1 - (percent / 100) ** ROWS))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    return np.unique(shingle_hashes(word_hashes(data)[0], words))


def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``n`` multiply-shift hash functions."""
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return seeds[:n] | np.uint64(1), seeds[n:]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the upper halves of a * x + b for each function."""
    out = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 256):
        part = a[:, None] * shingles[None, at : at + 256]
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out >> np.uint64(24)


def sketches(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """Per row of (doc_id, text): size of its set, a 128-bit name of the set, and band keys."""

    a, b = family(bands * ROWS)
    step = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40)

    def one(text: str | None) -> tuple:
        x = shingle_set(text, words)
        if not len(x):
            return 0, None, None, None
        m, key = minima(x, a, b), step
        for r in range(ROWS):
            key = mix(key + m[r::ROWS])
        return len(x), mix(x).sum(dtype=np.uint64).view(np.int64), np.bitwise_xor.reduce(mix(x + np.uint64(12345))).view(np.int64), key.view(np.int64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s1, s2, keys = zip(*map(one, pdf["text"]))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "s1": pd.array(s1, dtype="Int64"), "s2": pd.array(s2, dtype="Int64"), "keys": keys})

    return map_chunks(docs, run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, by a product of incidence matrices."""
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)

    def incidence(sets: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, values)
        hit = both[np.minimum(at, len(both) - 1)] == values if len(both) else np.zeros(len(values), dtype=bool)
        return of[hit], at[hit]

    out = np.zeros((len(left), len(right)), dtype=np.float32)
    (of_x, at_x), (of_y, at_y) = incidence(left, x), incidence(right, y)
    for low in range(0, len(both), 4096):
        part = []
        for n, of, at in ((len(left), of_x, at_x), (len(right), of_y, at_y)):
            m = np.zeros((n, 4096), dtype=np.float32)
            here = (at >= low) & (at < low + 4096)
            m[of[here], at[here] - low] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return np.rint(out).astype(np.int64)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        id_a, set_a, keep = None, np.zeros(0), []
        for a, x, y in zip(pdf["a"], pdf["left"], pdf["right"]):
            if a != id_a:
                id_a, set_a = a, shingle_set(x, words)
            set_b = shingle_set(y, words)
            both = len(np.intersect1d(set_a, set_b, assume_unique=True))
            keep.append(100 * both >= percent * (len(set_a) + len(set_b) - both))
        return pdf.loc[keep, ["a", "b"]]

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return map_chunks(joined, run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    bands = bands_for(percent)
    made = cut(sketches(docs, words, bands), TEXTS)
    linkable = made.where("n > 0 and doc_id is not null")
    classes = linkable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    mine = cut(made.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")))
    reps = linkable.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    members = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("node")).distinct()
    kept: dict[str, DataFrame] = {}

    def verify(pairs: DataFrame, large: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(large.select(F.col("node").alias("doc_id")))
        kept["texts"] = cut(docs.join(ids.distinct(), "doc_id"))
        return cut(verified(pairs, kept["texts"], words, percent), TEXTS)

    def payload(nodes: DataFrame) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"node": pdf["doc_id"], "data": [shingle_set(t, words).tobytes() for t in pdf["text"]]})

        return map_chunks(kept["texts"].join(nodes.withColumnRenamed("node", "doc_id"), "doc_id"), run, "node long, data binary")

    def compare(left: list[bytes], right: list[bytes]) -> np.ndarray:
        x, y = ([np.frombuffer(d, dtype=np.uint64) for d in side] for side in (left, right))
        both = overlaps(x, y)
        union = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - both
        return 100 * both >= percent * union

    found = link(cut(sized(members)), verify, payload, compare)
    out = mine.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
