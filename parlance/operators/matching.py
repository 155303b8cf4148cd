"""Alignment, fuzzy matching and scoring of words. Small per-row helpers run in Arrow batches; joins and sums are Spark's."""

from __future__ import annotations

import difflib
import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import bin_of, merge_gaps, overlap

MATCH, INSERT, DELETE, REPLACE = 0, 3, 3, 4
ECHO_WINDOW_US, ECHO_COVERAGE, ECHO_MIN_WORDS = 2_000_000, 0.8, 3
CORRECTION, SHORTEST_TERM = 0.95, 4


def _structs(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


def _directions(ref: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """For each pair of lengths the last step of the cheapest alignment, a row at a time: 0 on the diagonal, 1 an insertion, 2 a deletion."""
    place = np.arange(len(hyp) + 1) * INSERT
    before, out = place.copy(), np.zeros((len(ref) + 1, len(hyp) + 1), dtype=np.uint8)
    out[0, 1:] = 1
    for i, x in enumerate(ref.tolist(), 1):
        diagonal = before[:-1] + np.where(hyp == x, MATCH, REPLACE)
        row = np.append(i * DELETE, np.minimum(diagonal, before[1:] + DELETE))
        row = np.minimum.accumulate(row - place) + place  # insertions along the row
        out[i, 0] = 2
        out[i, 1:] = np.where(row[1:] == diagonal, 0, np.where(row[1:] == row[:-1] + INSERT, 1, 2))
        before = row
    return out


def aligned(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """Cheapest steps (m, s, i or d, place in ref, place in hyp); on equal cost the diagonal is taken, then insertion, then deletion. Equal ends need no table."""
    i, j, steps = len(ref), len(hyp), []
    while i and j and ref[i - 1] == hyp[j - 1]:
        i, j = i - 1, j - 1
        steps.append(("m", i, j))
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(w, len(code)) for w in side], dtype=np.int64) for side in (ref[:i], hyp[:j]))
    table = _directions(x, y)
    while i or j:
        way = table[i, j]
        if way == 0:
            i, j = i - 1, j - 1
            steps.append(("m" if x[i] == y[j] else "s", i, j))
        elif way == 1:
            j -= 1
            steps.append(("i", i, j))
        else:
            i -= 1
            steps.append(("d", i, j))
    return steps[::-1]


@F.arrow_udf(_structs(step=T.StringType(), ref=T.IntegerType(), hyp=T.IntegerType()))
def align(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    # Steps are kept as plain numbers, as a batch has some ten thousand rows of many steps.
    kinds, places, others, ends = bytearray(), array("i"), array("i"), array("i", [0])
    for r, h in zip(ref, hyp):
        for step, i, j in aligned(r.as_py(), h.as_py()):
            kinds.append("msid".index(step))
            places.append(i)
            others.append(j)
        ends.append(len(kinds))
    names = pa.array(list("msid")).take(pa.array(np.frombuffer(kinds, dtype=np.uint8)))
    steps = pa.StructArray.from_arrays([names, pa.array(np.frombuffer(places, dtype=np.int32)), pa.array(np.frombuffer(others, dtype=np.int32))], names=["step", "ref", "hyp"])
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), steps)


def error_counts(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """``rows`` with matches, substitutions, insertions, deletions and ``wer`` (null for an empty reference)."""
    steps = rows.withColumn("_steps", align(ref, hyp))
    count = lambda s: F.size(F.filter("_steps", lambda x: x["step"] == s))
    counted = steps.select(*rows.columns, count("m").alias("matches"), count("s").alias("substitutions"), count("i").alias("insertions"), count("d").alias("deletions"))
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return counted.withColumn("wer", errors / F.nullif(F.size(ref), F.lit(0)))


def biased_counts(rows: DataFrame, ref: str, hyp: str, biased: str) -> DataFrame:
    """Sums of errors over words in the row's list of biased words and over the others: (b_ref, b_errors, u_ref, u_errors)."""
    steps = rows.withColumn("_steps", align(ref, hyp)).select(ref, hyp, biased, F.explode("_steps").alias("s"))
    word = F.when(F.col("s.step") == "i", F.get(F.col(hyp), F.col("s.hyp"))).otherwise(F.get(F.col(ref), F.col("s.ref")))
    inside, wrong, is_ref = F.array_contains(F.col(biased), word), F.col("s.step") != "m", F.col("s.step") != "i"
    return steps.agg(*[F.count_if(a & b).alias(n) for n, a, b in (("b_ref", inside, is_ref), ("b_errors", inside, wrong), ("u_ref", ~inside, is_ref), ("u_errors", ~inside, wrong))])


def covered(short: str, long: str) -> float:
    """Characters of ``short`` found in order in ``long``, over the longer of its length and the stretch they take there."""
    blocks = [b for b in difflib.SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return 0.0
    return sum(b.size for b in blocks) / max(len(short), blocks[-1].b + blocks[-1].size - blocks[0].b)


@F.pandas_udf(T.DoubleType())
def coverage(short: pd.Series, long: pd.Series) -> pd.Series:
    return pd.Series([covered(a, b) for a, b in zip(short, long)])


def common_length(a: str, b: str) -> int:
    """Letters of the longest common subsequence, by bit-parallel columns in whole integers."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & masks.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def covers(short: str, long: str, least: float) -> bool:
    """Whether ``covered`` is at least ``least`` (over 0). It is 1 for a part of ``long``, and never more than the share of the longest common subsequence, so most pairs need no blocks."""
    if short and short in long:
        return least <= 1
    if not short or common_length(short, long) / len(short) < least:
        return False
    return covered(short, long) >= least


@F.pandas_udf(T.BooleanType())
def echoed(short: pd.Series, long: pd.Series) -> pd.Series:
    return pd.Series([covers(a, b, ECHO_COVERAGE) for a, b in zip(short, long)], dtype=bool)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(_structs(tag=T.StringType(), i1=T.IntegerType(), i2=T.IntegerType(), j1=T.IntegerType(), j2=T.IntegerType()))
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Blocks of two word lists that are equal or differ."""
    names = ("tag", "i1", "i2", "j1", "j2")
    return pd.Series([[dict(zip(names, o)) for o in difflib.SequenceMatcher(None, list(x), list(y), autojunk=False).get_opcodes()] for x, y in zip(a, b)])


def without_echo(mic: DataFrame, system: DataFrame, words: Column) -> DataFrame:
    """Mic lines (meeting, seq, text, start_us, end_us) but those that a system line within 2 s on either side covers. Lines of fewer than three words stay."""
    width = 30_000_000
    reach = lambda df: F.explode(F.sequence(bin_of(F.col("start_us") - ECHO_WINDOW_US, width), bin_of(F.col("end_us") + ECHO_WINDOW_US, width)))
    a = mic.withColumn("_words", words).where(F.size("_words") >= ECHO_MIN_WORDS).select("meeting", "seq", "start_us", "end_us", F.array_join("_words", " ").alias("a"), reach(mic).alias("bin"))
    b = system.withColumn("_words", words).select("meeting", F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.array_join("_words", " ").alias("b"), F.explode(F.sequence(bin_of(F.col("start_us"), width), bin_of(F.col("end_us"), width))).alias("bin"))
    near = a.join(b, ["meeting", "bin"]).where((F.col("e") >= F.col("start_us") - ECHO_WINDOW_US) & (F.col("s") <= F.col("end_us") + ECHO_WINDOW_US)).drop("bin").distinct()
    echoes = near.where(echoed("a", "b")).select("meeting", "seq").distinct()
    return mic.join(echoes, ["meeting", "seq"], "left_anti")


def norm(text: str) -> str:
    """Case folded and decomposed, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if c.isalnum())


@F.pandas_udf(T.StringType())
def keyed(text: pd.Series) -> pd.Series:
    """``norm`` of each text; null stays."""
    return text.map(lambda t: t if t is None else norm(t))


_EDGES = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


class Glossary:
    """Terms by their number of words, with what is needed to reject most candidates without comparing them letter by letter."""

    def __init__(self, terms: list[str], threshold: float = CORRECTION):
        self.threshold, known = threshold, {}
        for t in terms:
            if len(norm(t)) >= SHORTEST_TERM:
                known.setdefault(norm(t), t)
        self.by_size: dict[int, list[tuple[str, Counter, list[str], bool]]] = defaultdict(list)
        for key, t in known.items():
            self.by_size[len(t.split())].append((key, Counter(key), t.split(), t.islower()))
        self.sizes = sorted(self.by_size, reverse=True)
        self.met: dict[tuple[int, str], tuple[list[str], bool] | None] = {}

    def best(self, size: int, heard: str) -> tuple[list[str], bool] | None:
        """The term of ``size`` words most like ``heard``, the first of equals, if it reaches the threshold."""
        if (size, heard) not in self.met:
            found, top, letters = None, 0.0, Counter(heard)
            for key, counts, tokens, lower in self.by_size[size]:
                total = len(heard) + len(key)
                bound = 2 * min(len(heard), len(key)) / total
                if bound < self.threshold or bound <= top or 2 * (letters & counts).total() < self.threshold * total:
                    continue
                score = difflib.SequenceMatcher(None, heard, key).ratio()
                if score >= self.threshold and score > top:
                    found, top = (tokens, lower), score
            self.met[size, heard] = found
        return self.met[size, heard]

    def corrected(self, words: list[str]) -> list[str]:
        """Runs of words that nearly spell a term of as many words get its spelling, word by word: left to right, the most words first, the best score.

        Outer punctuation and the number of words stay, so timings do too. A term in lower case
        keeps the capital of each word that it replaces.
        """
        parts = [_EDGES.match(w).groups() for w in words]
        norms, out, at = [norm(core) for _, core, _ in parts], list(words), 0
        while at < len(words):
            for size in self.sizes:
                heard = "".join(norms[at : at + size])
                if at + size <= len(words) and heard and (found := self.best(size, heard)):
                    for k, token in enumerate(found[0], at):
                        lead, core, trail = parts[k]
                        if found[1] and core[:1].isupper():
                            token = token[:1].upper() + token[1:]
                        out[k] = lead + token + trail
                    at += size
                    break
            else:
                at += 1
        return out


def corrected(words: list[str], terms: list[str], threshold: float = CORRECTION) -> list[str]:
    return Glossary(terms, threshold).corrected(words)


def correct(rows: DataFrame, words: str, terms: str, threshold: float = CORRECTION) -> DataFrame:
    """``rows`` with the array of words corrected by the row's own array of terms. Texts are corrected apart from words, as arrays of their own."""

    @F.pandas_udf("array<string>")
    def run(ws: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([corrected(list(w), list(t), threshold) for w, t in zip(ws, ts)])

    return rows.withColumn(words, run(words, terms))


def assignment(gain: list[list[int]]) -> list[int]:
    """The column of each row (-1: none) with the greatest total gain. Up to seven names by trying all orders, else by augmenting paths."""
    rows, cols = len(gain), len(gain[0]) if gain else 0
    n = max(rows, cols)
    full = [[gain[i][j] if i < rows and j < cols else 0 for j in range(n)] for i in range(n)]
    if n <= 7:
        best = max(permutations(range(n)), key=lambda p: sum(full[i][j] for i, j in enumerate(p)), default=())
        return [j if j < cols else -1 for j in best[:rows]]
    top = max(map(max, full))
    cost = [[top - x for x in row] for row in full]
    u, v, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, way = [float("inf")] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    out = [-1] * rows
    for j in range(1, cols + 1):
        if 0 < owner[j] <= rows:
            out[owner[j] - 1] = j - 1
    return out


FRAME_US, COLLAR_US = 10_000, 250_000


FRAME_BIN = 3_000


def frame_spans(turns: DataFrame) -> DataFrame:
    """Active 10 ms frames of turns as disjoint half-open spans (channel, speaker, low, high); bounds are rounded half to even."""
    at = lambda c: F.greatest(F.lit(0), F.bround(F.col(c) / float(FRAME_US)).cast("long"))
    spans = turns.select("channel", "speaker", at("start_us").alias("low"), at("end_us").alias("high")).where("high > low")
    return merge_gaps(spans, ["channel", "speaker"], "low", "high", 0)


def collar_spans(ref: DataFrame, collar_us: int = COLLAR_US) -> DataFrame:
    """Frames within the collar of a reference boundary, as disjoint spans (channel, low, high)."""
    half = collar_us // FRAME_US
    bounds = ref.select("channel", F.explode(F.array("start_us", "end_us")).alias("t")).select("channel", F.bround(F.col("t") / float(FRAME_US)).cast("long").alias("b")).distinct()
    spans = bounds.select("channel", (F.col("b") - half).alias("low"), (F.col("b") + half).alias("high")).where("high > low")
    return merge_gaps(spans, ["channel"], "low", "high", 0)


def diarization_sums(r: DataFrame, h: DataFrame, masked: DataFrame) -> DataFrame:
    """Per channel the frames outside the mask: of reference speakers, missed, false alarms, and of pairs that could match; from one sweep over the spans' bounds."""
    kinds = [("r", r), ("h", h), ("m", masked)]
    parts = [df.select("channel", "low", "high", *[F.lit(int(k == name)).alias(k) for k, _ in kinds]) for name, df in kinds]
    spans = parts[0].unionByName(parts[1]).unionByName(parts[2])
    edge = lambda t, sign: F.struct(F.col(t).alias("t"), *[(F.col(k) * sign).alias(k) for k, _ in kinds])
    edges = spans.select("channel", F.explode(F.array(edge("low", 1), edge("high", -1))).alias("e")).groupBy("channel", F.col("e.t").alias("t")).agg(*[F.sum(f"e.{k}").alias(k) for k, _ in kinds])
    order = W.partitionBy("channel").orderBy("t")
    active = edges.select("channel", (F.lead("t").over(order) - F.col("t")).alias("n"), *[F.sum(k).over(order).alias(k) for k, _ in kinds]).where("n is not null and m = 0")
    zero = F.lit(0)
    return active.groupBy("channel").agg(
        F.sum(F.col("n") * F.col("r")).alias("ref_frames"), F.sum(F.col("n") * F.greatest(F.col("r") - F.col("h"), zero)).alias("missed"),
        F.sum(F.col("n") * F.greatest(F.col("h") - F.col("r"), zero)).alias("false_alarm"), F.sum(F.col("n") * F.least("r", "h")).alias("paired"),
        F.sum(F.col("n") * (F.col("r") + F.col("h"))).alias("_all"),
    ).where("_all > 0").drop("_all")


def shared_frames(r: DataFrame, h: DataFrame, masked: DataFrame) -> DataFrame:
    """(channel, ref_speaker, hyp_speaker, n): frames outside the mask in which both are active."""
    left = r.select("channel", F.col("speaker").alias("ref_speaker"), F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    right = h.select("channel", F.col("speaker").alias("hyp_speaker"), F.col("low").alias("h_low"), F.col("high").alias("h_high"))
    both = overlap(left, right, ["channel"], ("r_low", "r_high"), ("h_low", "h_high"), FRAME_BIN).select(
        "channel", "ref_speaker", "hyp_speaker", F.greatest("r_low", "h_low").alias("low"), F.least("r_high", "h_high").alias("high"), "shared"
    )
    mask = masked.select("channel", F.col("low").alias("m_low"), F.col("high").alias("m_high"))
    hidden = overlap(both.drop("shared"), mask, ["channel"], ("low", "high"), ("m_low", "m_high"), FRAME_BIN).select("channel", "ref_speaker", "hyp_speaker", (-F.col("shared")).alias("shared"))
    total = both.select("channel", "ref_speaker", "hyp_speaker", "shared").unionByName(hidden)
    return total.groupBy("channel", "ref_speaker", "hyp_speaker").agg(F.sum("shared").alias("n")).where("n > 0")


@F.pandas_udf(T.LongType())
def _most_matched(cells: pd.Series) -> pd.Series:
    """The largest sum of one-to-one partners' cells (a, b, n) for each list."""
    out = []
    for row in cells:
        a, b = ({x: k for k, x in enumerate(sorted({c[side] for c in row}))} for side in ("a", "b"))
        gain = [[0] * len(b) for _ in a]
        for c in row:
            gain[a[c["a"]]][b[c["b"]]] += int(c["n"])
        out.append(sum(gain[i][j] for i, j in enumerate(assignment(gain)) if j >= 0))
    return pd.Series(out, dtype="int64")


def best_partners(shared: DataFrame, key: str, a: str, b: str, n: str = "n") -> DataFrame:
    """(key, total, matched): the sum of all cells (key, a, b, n), and of those of the best one-to-one partners. A key has a cell for each pair of names."""
    cells = F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).alias("n")))
    return shared.groupBy(key).agg(F.sum(n).alias("total"), cells.alias("_cells")).select(key, "total", _most_matched("_cells").alias("matched"))


def diarization_errors(ref: DataFrame, hyp: DataFrame, collar_us: int = COLLAR_US) -> DataFrame:
    """Per channel: reference, missed, false-alarm and confused frames under the best one-to-one naming, and their rate.

    The work follows the number of turns, not their length in frames.
    """
    r, h, masked = frame_spans(ref), frame_spans(hyp), collar_spans(ref, collar_us)
    sums, shared = diarization_sums(r, h, masked), shared_frames(r, h, masked)

    correct = best_partners(shared, "channel", "ref_speaker", "hyp_speaker").select("channel", F.col("matched").alias("correct"))
    rows = sums.join(correct, "channel", "left").withColumn("confusion", F.col("paired") - F.coalesce("correct", F.lit(0)))
    der = (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.greatest("ref_frames", F.lit(1))
    return rows.select("channel", "ref_frames", "missed", "false_alarm", "confusion", F.round(der, 6).alias("der"))
