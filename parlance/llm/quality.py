"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself, of the line before and of the line
after, and from its neighbours' labels. Forward and backward passes give each line's marginal
probability of good; the mean weighted by line length, calibrated on the training documents,
is the document's score.

Training documents are those with a label whose id's crc32 modulo 3 is not 1, that no other row
shares the id of, and that have at most ``DOC_LINES`` lines; at most ``SAMPLE`` of them are used,
chosen by the smallest hash of the id, and no more than have ``LINES`` lines together. All lines
of a training document carry its label. Scores read whole texts, however many lines they have,
and nothing else.

Null and empty texts are one empty line and get the score of that. Without training rows every
score is 0.5. A null id is neither held out nor learned from. Repeated rows each get a row;
labels that contradict each other are all learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, map_chunks, mix, table, word_hashes

SAMPLE, DOC_LINES, LINES, SEED = 3000, 256, 150_000, 9
LETTERS, CAPITALS, DIGITS, SPACES, COMMON, MARKS, HIGH = range(7)
_CLASS = np.full(256, MARKS, dtype=np.int64)
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = LETTERS
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = CAPITALS
_CLASS[[ord(c) for c in "0123456789"]] = DIGITS
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACES
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = COMMON
_CLASS[128:] = HIGH
_FEED = np.uint8(10)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of some texts: their own features, length in bytes, and each text's first line (with the total at the end)."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace"), dtype=np.uint8)
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([t.count("\n") + 1 for t in texts], out=first[1:])
    n = int(first[-1])
    feeds = data == _FEED
    line = np.zeros(len(data), dtype=np.int64)
    np.cumsum(feeds[:-1], out=line[1:])
    kinds = np.bincount(line * 7 + _CLASS[data], minlength=7 * n).reshape(n, 7).astype(np.float64)
    length = np.bincount(line[~feeds], minlength=n).astype(np.float64)
    hashes, starts = word_hashes(data)
    of = line[starts] if len(starts) else np.zeros(0, dtype=np.int64)
    words = np.bincount(of, minlength=n).astype(np.float64)
    same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    again = np.bincount(of[1:][same], minlength=n)
    _, once = np.unique(mix(hashes ^ mix(of.astype(np.uint64))), return_index=True)
    distinct = np.bincount(of[once], minlength=n)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    in_doc = doc[of]
    _, once = np.unique(mix(hashes ^ mix(in_doc.astype(np.uint64) + np.uint64(1 << 40))), return_index=True)
    fresh = np.bincount(of[once], minlength=n)
    whole = np.zeros(n, dtype=np.uint64)
    np.add.at(whole, of, mix(hashes + np.arange(len(hashes), dtype=np.uint64) - np.searchsorted(of, of).astype(np.uint64)))
    _, back, times = np.unique(whole ^ mix(doc.astype(np.uint64)), return_inverse=True, return_counts=True)
    times = times[back]
    size, count = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(kinds[:, LETTERS] + kinds[:, CAPITALS] + kinds[:, HIGH], 1)
    own = np.column_stack([
        np.log1p(length) / 6, np.log1p(words) / 4, np.minimum(length / count / 12, 2), length == 0,
        kinds[:, CAPITALS] / letters, kinds[:, CAPITALS] > 0.5 * letters, kinds[:, DIGITS] / size, kinds[:, COMMON] / size * 5,
        kinds[:, MARKS] / size * 5, np.minimum(kinds[:, MARKS] / count, 3), kinds[:, SPACES] / size, kinds[:, HIGH] / size,
        again / count, distinct / count, fresh / count, (fresh / count < 0.4) & (words > 4), times > 1, np.minimum(times - 1, 10) / 5,
    ]).astype(np.float64)
    return own, size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The features of every line beside those of the line before and after it, a constant, and flags for a text's first and last line."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edge = np.zeros((len(own), 3))
    edge[:, 0] = 1
    edge[first[:-1], 1] = 1
    edge[first[1:] - 1, 2] = 1
    return np.hstack([own, before, after, edge])


def _step(x: np.ndarray, stay: tuple[float, float]) -> np.ndarray:
    """Log odds of good on the next line, from log odds on this one."""
    return np.logaddexp(0, stay[1] + x) - np.logaddexp(stay[0], x)


def marginals(scores: list[float], stay: tuple[float, float]) -> list[float]:
    """Probability of good for each line of a document by forward and backward messages."""
    bad, good = math.exp(stay[0]), math.exp(stay[1])

    def send(x: float) -> float:
        if x > 30:
            return stay[1] + math.log1p(math.exp(-x) / good) - math.log1p(bad * math.exp(-x))
        e = math.exp(x)
        return math.log((1 + good * e) / (bad + e))

    n = len(scores)
    ahead, out = [0.0] * n, [0.0] * n
    for t in range(1, n):
        ahead[t] = send(ahead[t - 1] + scores[t - 1])
    behind = 0.0
    for t in range(n - 1, -1, -1):
        x = ahead[t] + scores[t] + behind
        out[t] = 1.0 / (1.0 + math.exp(-x)) if x > -500 else 0.0
        behind = send(behind + scores[t])
    return out


class Model:
    def __init__(self, weights: np.ndarray, stay: tuple[float, float], mean: np.ndarray, scale: np.ndarray, calibration: tuple[float, float]):
        self.weights, self.stay, self.mean, self.scale, self.calibration = weights, stay, mean, scale, calibration

    def line_scores(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each line's log odds of good from its features and its neighbours', without a table of both."""
        w, n = self.weights / self.scale, own.shape[1]
        out = own @ w[:n] + (w[-3] - self.mean @ w)
        from_before, from_after = (own @ w[n : 2 * n])[:-1], (own @ w[2 * n : 3 * n])[1:]
        from_before[first[1:-1] - 1] = 0
        from_after[first[1:-1] - 1] = 0
        out[1:] += from_before
        out[:-1] += from_after
        out[first[:-1]] += w[-2]
        out[first[1:] - 1] += w[-1]
        return out

    def raw(self, own: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted log odds of good per document."""
        scores = self.line_scores(own, first).tolist()
        out = np.zeros(len(first) - 1)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            p = float(np.average(marginals(scores[a:b], self.stay), weights=size[a:b]))
            out[k] = math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        a, b = self.calibration
        out = np.zeros(len(texts))
        at = 0
        for block in blocks(texts):
            out[at : at + len(block)] = 1 / (1 + np.exp(-(a * self.raw(*line_features(block)) + b)))
            at += len(block)
        return out


def blocks(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _gradient(scores: np.ndarray, lengths: np.ndarray, labels: np.ndarray, stay: tuple[float, float]):
    """Marginals of padded documents (longest first), and expected minus seen stays of both labels."""
    docs, longest = scores.shape
    active = [int((lengths > t).sum()) for t in range(longest)]
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    for t in range(1, longest):
        k = active[t]
        ahead[:k, t] = _step(ahead[:k, t - 1] + scores[:k, t - 1], stay)
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]
        behind[:k, t] = _step(behind[:k, t + 1] + scores[:k, t + 1], stay)
    p = 1 / (1 + np.exp(-np.clip(ahead + scores + behind, -500, 500)))
    edges = np.zeros(2)
    for t in range(longest - 1):
        k = active[t + 1]
        left, right = ahead[:k, t] + scores[:k, t], behind[:k, t + 1] + scores[:k, t + 1]
        logs = np.stack([np.full(k, stay[0]), right, left, stay[1] + left + right])
        logs = np.exp(logs - logs.max(axis=0))
        logs /= logs.sum(axis=0)
        edges += [(logs[0] - (1 - labels[:k])).sum(), (logs[3] - labels[:k]).sum()]
    return p, edges


def fit_arrays(own: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = 120) -> Model:
    """Weights by gradient steps on the log likelihood, then a calibration of the document score."""
    x = with_neighbours(own, first)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    mean[-3], scale[-3] = 0, 1
    z = np.clip((x - mean) / scale, -8, 8)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts, y = lengths[order], first[:-1][order], labels[order].astype(np.float64)
    where = np.zeros((len(order), int(lengths[0])), dtype=np.int64)
    mask = np.arange(where.shape[1])[None, :] < lengths[:, None]
    where[mask] = (starts[:, None] + np.arange(where.shape[1])[None, :])[mask]
    weigh = 1.0 / lengths  # a long document counts as much as a short one
    w, stay = np.zeros(z.shape[1]), np.zeros(2)
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for step in range(1, steps + 1):
        scores = np.where(mask, (z @ w)[where], 0)
        p, edges = _gradient(scores, lengths, y, tuple(stay))
        residual = np.where(mask, (p - y[:, None]) * weigh[:, None], 0)
        flat = np.zeros(len(z))
        flat[where[mask]] = residual[mask]
        g = np.concatenate([flat @ z / len(y) + 1e-3 * w, edges / max(1, mask.sum()) + 0.02 * stay])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, stay = w - move[:-2], np.clip(stay - move[-2:], -3, 3)
    model = Model(w, (float(stay[0]), float(stay[1])), mean, scale, (1.0, 0.0))
    raw = model.raw(own, size, first)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-(a * raw + b)))
        s = p * (1 - p)
        h = np.array([[(s * raw * raw).sum() + 1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-3]])
        step2 = np.linalg.solve(h, [((p - labels) * raw).sum() + (a - 1), (p - labels).sum()])
        a, b = a - np.clip(step2[0], -1, 1), b - np.clip(step2[1], -1, 1)
    model.calibration = (max(float(a), 1e-3), float(b))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learned from a bounded sample of labelled documents."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "quality"), 11) / float(1 << 53)
    usable = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (id_fold("doc_id", 3) != 1)).distinct()
    n = usable.count()
    chosen = usable.withColumn("draw", draw).where(F.col("draw") < 1.5 * sample / max(n, 1)).orderBy("draw", "doc_id").limit(sample)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [line_features([t or ""]) for t in pdf["text"]]
        pack = lambda arrays: [x.astype("<f4").tobytes() for x in arrays]
        return pdf[["doc_id", "quality", "draw"]].assign(lines=[len(m[1]) for m in made], x=pack(m[0] for m in made), size=pack(m[1] for m in made))

    # The sample has at most ``sample`` rows of a few numbers, so it can be broadcast.
    single = docs.select("doc_id").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").count().where("count = 1").select("doc_id")
    chosen = chosen.join(single, "doc_id").select("doc_id", "quality", "draw")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(lines, F.lit(1)) <= DOC_LINES).select("doc_id", "quality", "draw", "text")
    found = map_chunks(rows, run, "doc_id long, quality int, draw double, lines int, x binary, size binary").collect()
    found = sorted(found, key=lambda r: (r["draw"], r["doc_id"], r["quality"]))
    found = [r for r, held in zip(found, accumulate(r["lines"] for r in found)) if held <= LINES]
    width = line_features([""])[0].shape[1]
    if len({r["quality"] for r in found}) < 2:
        return Model(np.zeros(3 * width + 3), (0.0, 0.0), np.zeros(3 * width + 3), np.ones(3 * width + 3), (1.0, 0.0))
    own = np.concatenate([np.frombuffer(r["x"], dtype="<f4").reshape(-1, width) for r in found]).astype(np.float64)
    size = np.concatenate([np.frombuffer(r["size"], dtype="<f4") for r in found]).astype(np.float64)
    first = np.concatenate([[0], np.cumsum([r["lines"] for r in found])])
    return fit_arrays(own, size, first, np.array([r["quality"] for r in found]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``; a column of this name is replaced."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.fillna("").tolist()))

    return docs.drop("quality_score").withColumn("quality_score", run(F.col(text_col)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
