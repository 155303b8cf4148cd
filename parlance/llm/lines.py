"""Fuzzy line deduplication.

Lines are normalised (lower case, ASCII punctuation and white space to single spaces). Lines of at
least ``MIN_WORDS`` words take part; shorter ones always stay. Equal lines are one class. The
SimHash of a class consists of blocks of 64 bits, and lines that share a block are candidates.

In a SimHash whose bits all take votes from all words, one changed word touches every block, so
blocks long enough to be selective find few pairs at the wanted similarity. Here a block takes
votes from a part of the words only, so a changed word leaves the blocks alone in which it has no
vote:

* Lines of up to ``SHORT`` words have a block for each word, in which all other words vote, and
  one in which all vote. Two lines one edit apart (all that the similarity allows) share a block
  for certain, by the pigeonhole principle.
* In lines of ``LONG`` words or more a block takes the votes of three words, those of least hash
  under the block's own function divided by a weight that grows with the letters of the word (digits do not count, as
  numbers are what lines of one kind differ in), so that words that most lines hold seldom vote. Lines of under ``WIDE`` words have more blocks. At a
  similarity of 0.8 nine of ten pairs share a block, at 0.9 nearly all (README has figures).

Candidates are linked if the edit similarity of their words (1 - distance / longer length; words are compared by
hashes of 32 bits) is at least ``PERCENT`` / 100. Lines that are like no other of a bucket, the lines of a block, by signatures of
their words leave it first (``promising``). In a bucket all are compared with its leaders
(``leaders``), those first that share most large blocks with others. When the links that this finds are joined to groups, the
lines of a large bucket that are outside its main group are compared with all its lines of other groups, so that
all similar lines that share a block are connected. Of each connected group of lines the first occurrence, by document id and line number, is
kept; the others are removed.

A null or empty text has no lines that take part. A row with a null id takes no part and stays as
it is. Rows that repeat id and text count as one document; rows that repeat an id with other text
are documents of their own. Very long lines are compared whole. A column named ``n_lines`` or
``n_removed`` is replaced; other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BLOCK, rest_of_large
from .common import TEXTS, give_back, hashed_words, map_chunks, marked, mix, table, written
from .components import components, tied
from .leaders import leader_links, settled, weighed, whole_buckets

MIN_WORDS, PERCENT = 5, 80
SHORT, LONG, WIDE = 9, 8, 20
BLOCKS, MORE_BLOCKS, LARGE = 9, 12, 17
#: Words of 64 bits in the signature of a line.
SIGNATURE = 4
#: Pairs of signatures that are compared together.
PAIRS = 1 << 18
#: A key is hot if it has this many rows, and this share of all, in one of ``HOT_PARTS`` parts of the rows.
HOT, HOT_SHARE, HOT_PARTS = 16, 1e-4, 64
#: Lines for each bucket in which blocks are sorted (some ten pairs of 16 bytes a line).
LINES_A_BUCKET = 200_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalnum() and b != 10]] = 32
_FOLD[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] += 32
_SEEDS = mix(np.arange(1, MORE_BLOCKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_NAMES = mix(_SEEDS)
#: The bit that is set in blocks of short lines: what shares one is alike but for the order of words.
_SURE = np.uint64(1)


def folded(texts: list[str]) -> np.ndarray:
    return _FOLD[np.frombuffer(b"\n".join([t.lower().encode("utf-8", "surrogatepass") for t in texts]), dtype=np.uint8)]


def sampled_blocks(words: np.ndarray, length: np.ndarray, size: np.ndarray, which: range) -> np.ndarray:
    """A row per line: its blocks, each the majority of the bits of three of its words. ``size`` has the words of each line."""
    heads = np.cumsum(size) - size
    weight = 1.0 / np.maximum(1, np.minimum(length, 12) - 2)
    out = np.zeros((len(size), len(which)), dtype=np.uint64)
    for i, j in enumerate(which):
        rank = ((words * _SEEDS[j]) >> np.uint64(11)).astype(np.float64) * weight
        votes = []
        for vote in range(3):
            least = np.minimum.reduceat(rank, heads)
            votes.append(mix(least.view(np.uint64)))
            if vote < 2:
                np.putmask(rank, rank == np.repeat(least, size), np.inf)
        a, b, c = votes
        out[:, i] = ((a & b) | (a & c) | (b & c)) ^ _NAMES[j]
    return out


def short_blocks(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word the majority of the bits of the line's other words, and per line that of all."""
    bits = np.unpackbits(mix(words + np.uint64(7)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
    votes = np.add.reduceat(bits, np.cumsum(size) - size, axis=0)
    others = 2 * (np.repeat(votes, size, axis=0) - bits) > np.repeat(size - 1, size)[:, None]
    pack = lambda x: np.packbits(x, axis=1).view(np.uint64)[:, 0]
    return pack(others), pack(2 * votes > size[:, None])


def blocks_of(words: np.ndarray, length: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of all lines, and how many each line has. The first ``BLOCKS`` of a line of ``LONG`` words or more are sampled ones."""
    long, narrow, short = size >= LONG, (size >= LONG) & (size < WIDE), size <= SHORT
    many = long * BLOCKS + narrow * (MORE_BLOCKS - BLOCKS) + short * (size + 1)
    at = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), dtype=np.uint64)
    for lines, which in ((long, range(BLOCKS)), (narrow, range(BLOCKS, MORE_BLOCKS))):
        if lines.any():
            held = np.repeat(lines, size)
            out[at[lines][:, None] + np.array(which)] = sampled_blocks(words[held], length[held], size[lines], which)
    if short.any():
        own = size[short]
        others, whole = short_blocks(words[np.repeat(short, size)], own)
        base = at[short] + narrow[short] * MORE_BLOCKS
        out &= ~_SURE
        out[np.repeat(base, own) + np.arange(len(others)) - np.repeat(np.cumsum(own) - own, own)] = others | _SURE
        out[base + own] = whole | _SURE
        return out, many
    return out & ~_SURE, many


class Lines:
    """The lines of some texts that take part: words and their lengths without digits, words of each line, its text (the place in the list), number, a hash, and whether it is its text's first of its kind."""

    def __init__(self, texts: list[str]):
        data = folded(texts)
        words, starts, ends = hashed_words(data)
        of = np.cumsum(data == 10)[starts]
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(heads, len(of)))
        wide = size >= MIN_WORDS
        held, line = np.repeat(wide, size), of[heads][wide]
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        self.words, self.length, self.size = words[held], (ends - starts - digits[ends] + digits[starts])[held], size[wide]
        self.h1 = self.hashed(1)
        before = np.concatenate([[0], np.cumsum([t.count("\n") + 1 for t in texts])])
        self.text = np.searchsorted(before, line, side="right") - 1
        self.number = line - before[self.text]
        self.own = np.zeros(len(line), dtype=bool)
        self.own[np.unique(mix(self.h1 ^ mix(self.text.astype(np.uint64))), return_index=True)[1]] = True

    def hashed(self, seed: int) -> np.ndarray:
        """A hash of each line's words in order."""
        heads = np.cumsum(self.size) - self.size
        place = (np.arange(len(self.words)) - np.repeat(heads, self.size)).astype(np.uint64)
        return np.add.reduceat(mix(self.words ^ ((place + np.uint64(seed)) * _SEEDS[seed])), heads) if len(heads) else np.zeros(0, dtype=np.uint64)

    def packed(self) -> pa.Array:
        """The words of the lines that are their text's first of their kind, as hashes of 32 bits; nothing for the others."""
        ends = np.concatenate([[0], np.cumsum(4 * self.size * self.own)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.size), [None, pa.py_buffer(ends), pa.py_buffer((self.owned()[0] >> np.uint64(32)).astype(np.uint32))])

    def owned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, lengths and sizes of the lines that are their text's first of their kind."""
        held = np.repeat(self.own, self.size)
        return self.words[held], self.length[held], self.size[self.own]


def line_table(texts: list[str]) -> pa.RecordBatch:
    """A row for each line that takes part: text, line, two hashes, whether it is the text's first of its kind, and if it is, its blocks and its words, packed."""
    x = Lines(texts)
    many = np.zeros(len(x.size), dtype=np.int64)
    blocks, many[x.own] = blocks_of(*x.owned())
    ends = np.concatenate([[0], np.cumsum(8 * many)]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends), pa.py_buffer(blocks)])
    columns = {"text": pa.array(x.text), "line": pa.array(x.number), "h1": pa.array(x.h1.view(np.int64)), "h2": pa.array(x.hashed(2).view(np.int64)), "own": pa.array(x.own), "blocks": packed, "words": x.packed()}
    return pa.RecordBatch.from_pydict(columns)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, by bit-parallel columns in whole integers."""
    at = 0
    while at < min(len(a), len(b)) and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = masks.get(x, 0)
        vertical = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(flat | up)), up & flat
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(vertical | more)) & full, more & vertical
    return score


def similar(a: list, b: list, percent: int = PERCENT) -> bool:
    longer = max(len(a), len(b))
    if 100 * min(len(a), len(b)) < percent * longer:
        return False
    distinct = set(a)
    if 100 * (len(distinct.intersection(b)) + len(a) - len(distinct)) < percent * longer:
        return False  # too few common words, however they stand
    return 100 * (longer - edit_distance(a, b)) >= percent * longer


def enough(percent: int, wrong: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return 100 * (longer - wrong) >= percent * longer


def counted(bits: np.ndarray) -> np.ndarray:
    """How many bits are set in each signature."""
    out = np.zeros(bits.shape[:-1], dtype=np.int16)
    for k in range(SIGNATURE):
        out += np.bitwise_count(bits[..., k])
    return out


def possible(percent: int, n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines of ``n`` and ``m`` words with signatures ``x`` and ``y``, in which ``p`` and ``q`` bits are set, may be similar. The bits that one has and the other lacks are those of the fuller less those of both."""
    longer = np.maximum(n, m)
    missing = np.maximum(np.abs(n - m), np.maximum(p, q) - counted(x & y))
    return enough(percent, missing, longer) & (longer > 0)


class WordRows:
    """Packed words of some lines, and which pairs of them (by place) are similar.

    A line's words set bits of a signature. A bit that one line has and the other lacks stands for a word to
    replace or to drop, so most unlike pairs need no look at their words; most others have equal length and few unequal
    places. The edit distance is left for the rest.
    """

    def __init__(self, packed: pa.Array, nodes: np.ndarray, percent: int = PERCENT):
        packed = pa.array(packed, pa.binary())
        ends = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) if len(packed) else np.zeros(1, dtype=np.int64)
        self.words = np.frombuffer(packed.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].view(np.uint32)
        self.first, self.size, self.percent = (ends[:-1] - ends[0]) // 4, np.diff(ends) // 4, percent
        self.bits = np.zeros((len(packed), SIGNATURE), dtype=np.uint64)
        self.nodes, self.met = nodes, {}
        held = np.flatnonzero(self.size)
        if len(held):
            lane, bit = (self.words >> np.uint32(6)) % np.uint32(SIGNATURE), np.uint64(1) << (self.words & np.uint32(63)).astype(np.uint64)
            for k in range(SIGNATURE):
                self.bits[held, k] = np.bitwise_or.reduceat(np.where(lane == k, bit, np.uint64(0)), self.first[held])
        self.set = counted(self.bits)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        n, m = self.size[a], self.size[b]
        open_ = enough(self.percent, np.abs(n - m), np.maximum(n, m))
        near = np.flatnonzero(open_)
        open_[near] = possible(self.percent, n[near], m[near], self.set[a[near]], self.set[b[near]], self.bits[a[near]], self.bits[b[near]])
        even = np.flatnonzero(open_ & (n == m))
        if len(even):
            many = n[even]
            heads = np.cumsum(many) - many
            place = np.arange(int(many.sum())) - np.repeat(heads, many)
            unequal = self.words[np.repeat(self.first[a[even]], many) + place] != self.words[np.repeat(self.first[b[even]], many) + place]
            out[even] = enough(self.percent, np.add.reduceat(unequal, heads, dtype=np.int64), many)
        for i in np.flatnonzero(open_ & ~out).tolist():
            x, y = int(self.nodes[a[i]]), int(self.nodes[b[i]])
            pair = (x, y) if x < y else (y, x)
            if pair not in self.met:
                self.met[pair] = similar(self.of(a[i]), self.of(b[i]), self.percent)
            out[i] = self.met[pair]
        return out

    def of(self, i: int) -> list[int]:
        return self.words[self.first[i] : self.first[i] + self.size[i]].tolist()


def _possible(percent: int, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Which of two lists of packed lines may be similar: a row for each of ``a``."""
    x, y = (WordRows(pa.array(v, pa.binary()), np.arange(len(v)), percent) for v in (a, b))
    return possible(percent, x.size[:, None], y.size[None, :], x.set[:, None], y.set[None, :], x.bits[:, None], y.bits[None, :])


def _alike(percent: int, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Which of the packed lines in ``a`` are similar to those at the same place in ``b``."""
    return WordRows(pa.array([*a, *b], pa.binary()), np.arange(2 * len(a)), percent).alike(np.arange(len(a)), np.arange(len(a)) + len(a))


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, place, h1, h2, own, blocks, words) of all lines that take part; a place holds a checksum of the text and the line's number."""

    def run(batch: pd.DataFrame) -> pa.RecordBatch:
        found = line_table(batch["text"].tolist())
        text = found.column("text").to_numpy()
        place = batch["checksum"].to_numpy(dtype=np.int64)[text] << 32 | found.column("line").to_numpy()
        columns = [pa.array(batch["doc_id"].to_numpy(dtype=np.int64)[text]), pa.array(place), *found.columns[2:]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "h1", "h2", "own", "blocks", "words"])

    made = map_chunks(docs.select("doc_id", "text", _checksum().alias("checksum")), run, "doc_id long, place long, h1 long, h2 long, own boolean, blocks binary, words binary")
    return written(made, TEXTS)


def _checksum():
    """31 bits of the text's checksum, so that places are not negative."""
    return F.crc32(F.encode("text", "utf-8")).bitwiseAND(2147483647)


def unpacked(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of some lines, and how many each line has."""
    blocks = pa.array(blocks, pa.binary())
    ends = np.frombuffer(blocks.buffers()[1], dtype=np.int32)[blocks.offset : blocks.offset + len(blocks) + 1] if len(blocks) else np.zeros(1, dtype=np.int32)
    return np.frombuffer(blocks.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].view(np.int64), np.diff(ends) // 8


def exploded(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each block (key) of rows with ``blocks``, beside other columns of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, many = unpacked(batch.column("blocks"))
            rest = [pa.array(np.repeat(batch.column(c).to_numpy(), many)) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(key), *rest], names=["key", *columns])

    return rows.select("blocks", *columns).mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *columns)))


def among(hot: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys are in ``hot``, a short list in order."""
    return hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key if len(hot) else np.zeros(len(key), dtype=bool)


def _dealt(own: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """(bucket, pairs): the (key, node) of each batch of lines but those of hot keys, of equal lines once, packed by the bucket of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = np.unique(batch.column("h1").to_numpy(), return_index=True)[1]  # equal lines have equal blocks
            batch = batch.take(pa.array(once))
            key, many = unpacked(batch.column("blocks"))
            node = np.repeat(batch.column("h1").to_numpy(), many)
            keep = ~among(hot, key)
            key, node = key[keep], node[keep]
            bucket = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if parts <= 1 << 16 else bucket, kind="stable")  # narrow numbers are sorted by digits
            packed, bucket = np.column_stack([key[order], node[order]]), bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            found = bucket[first]
            ends = np.append(16 * first, 16 * len(packed)).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])
            yield pa.RecordBatch.from_arrays([pa.array(found), blobs], names=["bucket", "pairs"])
        give_back()

    return own.select("h1", "blocks").mapInArrow(run, "bucket long, pairs binary")


def _met(dealt: DataFrame, parts: int) -> DataFrame:
    """(key, home, node, size) of the keys that several nodes have, with the least of these; of keys of one kind with the same nodes only one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("pairs").to_pylist()]
        pairs = np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, 2)
        del blobs
        # Few keys stand in more than one pair: only these are ordered by node too.
        order = np.argsort(pairs[:, 0])
        same = np.diff(pairs[order, 0]) == 0
        pairs = pairs[order[np.append(same, False)[: len(order)] | np.append(False, same)[: len(order)]]]
        del order, same
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)]]
        heads = np.flatnonzero(np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)])
        size = np.diff(np.append(heads, len(pairs)))
        pairs = pairs[np.repeat(size > 1, size)]
        size = size[size > 1]
        if not len(size):
            return
        heads = np.cumsum(size) - size
        key, node = pairs[heads, 0], np.ascontiguousarray(pairs[:, 1])
        same = np.add.reduceat(mix(node.view(np.uint64)), heads).view(np.int64)
        for at in range(0, len(size), 4096):
            some = slice(at, at + 4096)
            held = slice(int(heads[at]), int(heads[some][-1] + size[some][-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads[some] - heads[at], held.stop - held.start), pa.int32()), pa.array(node[held]))
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(same[some]), pa.array(size[some]), lists], names=["key", "same", "size", "nodes"])
        del pairs, heads, node
        give_back()

    met = dealt.repartition(parts, "bucket").mapInArrow(run, "key long, same long, size long, nodes array<long>")
    once = met.withColumn("kind", F.col("key").bitwiseAND(1)).dropDuplicates(["same", "size", "kind"])
    return once.select("key", F.get("nodes", F.lit(0)).alias("home"), F.explode("nodes").alias("node"), "size")


def _hot_met(own: DataFrame, hot: np.ndarray) -> DataFrame:
    """The rows of ``_met`` for the keys ``hot`` (in order), whose sizes go through the driver; a key is its own home."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, many = unpacked(batch.column("blocks"))
            node = np.repeat(batch.column("h1").to_numpy(), many)
            keep = among(hot, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])

    keys = written(own.select("h1", "blocks").mapInArrow(held, "key long, node long").distinct())
    counted = {r["key"]: r["n"] for r in keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([counted.get(k, 0) for k in hot.tolist()], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            size = sizes[np.searchsorted(hot, key)]
            rows = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("key"), batch.column("node"), pa.array(size)], names=["key", "home", "node", "size"])
            yield rows.filter(pa.array(size > 1))

    return keys.mapInArrow(run, "key long, home long, node long, size long")


def shared_blocks(own: DataFrame, lines: int | None = None) -> DataFrame:
    """(key, home, node, size) for the blocks that several classes of lines have.

    Hot keys, found in a part of the rows, are counted by partial sums. All others are dealt into
    buckets, packed, and sorted there as plain arrays; the number of buckets follows that of the lines.
    """
    lines = own.count() if lines is None else lines
    explode = lambda rows: exploded(rows.withColumnRenamed("h1", "node"), "node")
    part = explode(own.where(F.pmod(F.xxhash64("doc_id", "place"), F.lit(HOT_PARTS)) == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    part = part.where(F.col("n") >= max(HOT, HOT_SHARE * BLOCKS * lines / HOT_PARTS))  # about 1 / HOT_SHARE rows at most
    hot = np.array(sorted(r["key"] for r in part.select("key").collect()), dtype=np.int64)
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + lines // LINES_A_BUCKET)
    found = _met(_dealt(own, hot, parts), parts)
    if len(hot):
        found = found.unionByName(_hot_met(own, hot))
    return written(found)


def with_partners(percent: int, starts: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which members of buckets that begin at ``starts`` may be similar to another of their bucket, by words and signatures of each."""
    n = len(size)
    ends = np.append(starts[1:], n)
    later = np.repeat(ends, ends - starts) - np.arange(n) - 1
    before, out, at, many = np.cumsum(later) - later, np.zeros(n, dtype=bool), 0, counted(bits)
    while at < n:
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS)))
        a = np.repeat(np.arange(at, to), later[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(before[at:to] - before[at], later[at:to])
        near = enough(percent, np.abs(size[a] - size[b]), np.maximum(size[a], size[b]))
        a, b = a[near], b[near]
        near = possible(percent, size[a], size[b], many[a], many[b], bits[a], bits[b])
        out[a[near]] = out[b[near]] = True
        at = to
    return out


def promising(own: DataFrame, shared: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """``shared`` (key, home, node, size) without those that no other member of their bucket can be similar to, by signature.

    The more lines there are the more of them share a block by chance. Their words need not go to its bucket. Buckets of
    over ``BLOCK`` members stay as they are.
    """
    lanes = [f"s{k}" for k in range(SIGNATURE)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = WordRows(batch.column("words"), np.zeros(0), percent)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(x.size), *(pa.array(np.ascontiguousarray(x.bits[:, k]).view(np.int64)) for k in range(SIGNATURE))], names=["node", "n", *lanes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches, "key"):
            key = rows.column("key").to_numpy()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            bits = np.column_stack([rows.column(c).to_numpy().view(np.uint64) for c in lanes])
            keep = with_partners(percent, starts, rows.column("n").to_numpy(), bits)
            left = np.add.reduceat(keep, starts, dtype=np.int64)
            size = np.repeat(left, np.diff(np.append(starts, len(key))))
            yield from rows.select(["key", "home", "node"]).append_column("size", pa.array(size)).filter(pa.array(keep)).to_batches()
        give_back()

    few = shared.where(F.col("size") <= BLOCK)
    some = marked(own.select(F.col("h1").alias("node"), "words"), "node", few.select("node")).where("_marked").select("node", "words")
    signed = some.mapInArrow(sign, ", ".join(f"{c} long" for c in ("node", "n", *lanes))).groupBy("node").agg(*(F.max(c).alias(c) for c in ("n", *lanes)))
    dealt = few.select("key", "home", "node").join(signed, "node").repartition(parts, "key").sortWithinPartitions("key")
    kept = dealt.mapInArrow(run, "key long, home long, node long, size long")
    return written(kept.unionByName(shared.where(F.col("size") > BLOCK)))


def _groups(own: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the lines that are similar to others with which they share a block."""
    lines = own.count()
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + lines // LINES_A_BUCKET)

    def words_of(nodes: DataFrame) -> DataFrame:
        """(node, data) of each of ``nodes``; the filter before the join keeps most other lines from the shuffle."""
        some = marked(own.select(F.col("h1").alias("node"), F.col("words").alias("data")), "node", nodes).where("_marked").drop("_marked").join(nodes, "node")
        return some.groupBy("node").agg(F.max("data").alias("data"))

    shared = promising(own, shared_blocks(own, lines), parts, percent)
    members = weighed(shared, LARGE).join(words_of(written(shared.select("node").distinct())), "node")
    links, _ = leader_links(members, parts, lambda packed, node: WordRows(packed, node, percent).alike, int(_SURE))
    found = written(components(links))
    large = shared.where(~settled(F.col("size"))).select("key", "node")
    more = rest_of_large(large, found, lambda nodes: words_of(written(nodes)), partial(_possible, percent), partial(_alike, percent))
    return written(tied(found, more))


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, checksum, lines): the numbers from 0 of the lines to remove from each document."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = _line_rows(docs)
    own = rows.where("own")
    checksum, number = F.shiftright("place", 32).alias("checksum"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int")

    groups = _groups(own, percent)
    classes = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.min_by("place", "doc_id").alias("first_place"), F.count(F.lit(1)).alias("n"))
    named = written(marked(classes, "h1", groups.select("node")).where("n > 1 or _marked").drop("_marked").join(groups, F.col("h1") == F.col("node"), "left").where("n > 1 or component is not null"))
    firsts = named.where("component is not null").groupBy("component").agg(F.min(F.struct("first_doc", "first_place")).alias("first"))
    repeated = named.join(firsts, "component", "left").select(
        "h1", "h2", F.coalesce("first.first_doc", "first_doc").alias("keep_doc"), F.coalesce("first.first_place", "first_place").alias("keep_place")
    )
    again = marked(own, "h1", named.select("h1")).where("_marked").join(repeated, ["h1", "h2"]).where("doc_id <> keep_doc or place <> keep_place")
    gone = rows.where("not own").select("doc_id", "place").unionByName(again.select("doc_id", "place"))
    return gone.groupBy("doc_id", checksum).agg(F.collect_set(number).alias("lines"))


def deduplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the lines removed from ``text``, and ``n_lines`` (before) and ``n_removed``. Documents that lose nothing are not shuffled."""
    kept = docs.drop("n_lines", "n_removed")
    drops = written(removed_lines(docs, percent)).select(F.col("doc_id").alias("_id"), F.col("checksum").alias("_checksum"), F.col("lines").alias("_drop"))
    flagged = marked(kept, "doc_id", drops.select("_id"))
    some = flagged.where("_marked").withColumn("_sum", _checksum())
    some = some.join(drops.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("_sum") == F.col("_checksum")), "left").select(*kept.columns, "_drop")

    @F.pandas_udf("string")
    def left(text: pd.Series, drop: pd.Series) -> pd.Series:
        out = []
        for t, gone in zip(text, drop):
            if gone is None or not len(gone):
                out.append(t)
                continue
            parts = t.split("\n")
            for i in sorted(gone.tolist(), reverse=True):
                del parts[i]
            out.append("\n".join(parts))
        return pd.Series(out, dtype=object)

    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1
    # Counted before the text is cut; rows that lose nothing don't leave the JVM.
    counted = lambda rows, drop: rows.withColumn("_n_lines", n_lines).withColumn("_n_removed", drop)
    cut = counted(some, F.coalesce(F.size("_drop"), F.lit(0))).withColumn("text", left("text", "_drop")).drop("_drop")
    joined = cut.unionByName(counted(flagged.where("not _marked").select(*kept.columns), F.lit(0)))
    return joined.select(*kept.columns, F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, and the SHA-256 and length of what is left."""
    left = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "n_removed", F.sha2(text, 256).alias("text_sha256"), F.char_length(text).cast("long").alias("n_chars"))
