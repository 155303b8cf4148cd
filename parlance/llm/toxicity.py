"""Toxic spans from a linear-chain conditional random field over the words of a document.

A word is a run of letters, compared in lower case. Its features are itself, its first three to six letters, its last four
and, with weights of their own, the words on both sides of it. Forward and backward passes
give each word's marginal probability of toxic; runs of words at ``SPAN`` or more are the offending spans.
A document's score is a calibrated logistic function of its largest marginal, of their sum and of their mean.

Labels mark documents, so words are labelled from them first: in a toxic document, a word is toxic
if one of its forms (the word, its first letters) is in so much larger a share of the toxic training
documents that chance does not explain it; all words of other documents are not.

Training documents are those with a label whose id's crc32 modulo 5 is not 0 and that no other row
shares the id of, of at most ``DOC_CHARS`` characters; at most ``SAMPLE`` are used, by the smallest hash of the id, and
no more than have ``CHARS`` characters together. Scores read whole texts and nothing else.

Null and empty texts and those without letters have no spans and the score of a document without
marginals. Without training rows of both labels every score is 0.5 and there are no spans. A null id is neither held out nor learned from. Repeated rows each
get a row; labels that contradict each other are all learned from. Columns of the added names are replaced.
"""

from __future__ import annotations

import sys
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, mix, table
from .quality import blocks

SAMPLE, DOC_CHARS, CHARS, SEED = 3000, 20_000, 4_000_000, 12
#: Weights, letters of the prefixes and of the suffix, features that neighbours take from a word, lanes in which chains are run, marginal of a span.
SLOTS, PREFIXES, SUFFIX, NEAR, LANES, SPAN = 1 << 18, (3, 4, 5, 6), 4, [0, 2], 1024, 0.5
#: A form marks toxic words if its share of toxic documents is ``RATIO`` times that of the others and differs by ``DEVIATIONS`` standard deviations, and ``LEAST`` and
#: ``LEAST_SHARE`` of them have it (more than a group of near copies).
RATIO, DEVIATIONS, LEAST, LEAST_SHARE, RIDGE = 4.0, 4.0, 4, 0.025, 0.05
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and its lower case where that is one code point."""
    if "lower" not in _tables:
        every = [chr(c) for c in range(sys.maxunicode + 1)]
        _tables["letter"] = np.fromiter((c.isalpha() for c in every), dtype=bool, count=len(every))
        _tables["lower"] = np.arange(len(every), dtype=np.uint32)
        for c in every:
            if c.isupper() and len(c.lower()) == 1:
                _tables["lower"][ord(c)] = ord(c.lower())
    return _tables["letter"], _tables["lower"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) < n:
        for name, base in (("p", _BASE), ("q", _INVERSE)):
            out = np.full(max(1 << 16, 1 << n.bit_length()), base, dtype=np.uint64)
            out[0] = 1
            _tables[name] = np.multiply.accumulate(out)
    return _tables["p"], _tables["q"]


class Words:
    """The words of some texts: the place of each one's text, its start and end there, and the place of its form among the distinct ones; ``forms`` has a hash of each feature of these, with the word itself first."""

    def __init__(self, texts: list[str]):
        letter, lower = _letters()
        data = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = letter[data]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        before = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.text = np.searchsorted(before, starts, side="right") - 1
        self.start, self.end = starts - before[self.text], ends - before[self.text]
        p, q = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])

        def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return mix((total[b] - total[a]) * q[a]) if len(a) else np.zeros(0, dtype=np.uint64)

        _, once, self.form = np.unique(hashed(starts, ends), return_index=True, return_inverse=True)
        a, b = starts[once], ends[once]
        cut = [np.where(b - a >= n, mix(hashed(a, np.minimum(a + n, b)) + np.uint64(n)), 0) for n in PREFIXES]
        tail = np.where(b - a > SUFFIX, mix(hashed(np.maximum(b - SUFFIX, a), b) + np.uint64(99)), 0)
        self.forms = np.column_stack([hashed(a, b), *cut, tail]).astype(np.uint64).reshape(len(a), len(PREFIXES) + 2)
        self.first = np.zeros(len(starts), dtype=bool)
        self.first[np.unique(self.text, return_index=True)[1]] = True


def slots(forms: np.ndarray, role: int) -> np.ndarray:
    """The weight of each feature in a role (0 the word, 1 the word before it, 2 the word after); features that a short word lacks share the first."""
    return np.where(forms == 0, 0, 1 + (mix(forms + np.uint64(role << 32)) % np.uint64(SLOTS - 1)).astype(np.int64)).astype(np.int64)


def _reach(emission: np.ndarray, first: np.ndarray, stay: tuple[float, float]) -> np.ndarray:
    """For each word of a sequence of chains the log odds of toxic that the words before it in its chain send to it.

    The sequence is cut into lanes that run side by side, once from either label: what a lane starts
    with then follows from the lanes before it, and a second run gives the messages.
    """
    n = len(emission)
    lanes = max(1, min(LANES, n // 64))
    long = -(-n // lanes)
    weigh, fresh = np.ones(lanes * long), np.zeros(lanes * long, dtype=bool)
    weigh[:n], fresh[:n] = np.exp(np.clip(emission, -30, 30)), first
    weigh, fresh = weigh.reshape(lanes, long).T.copy(), fresh.reshape(lanes, long).T.copy()
    keep_clean, keep_toxic = np.where(fresh, 1.0, np.exp(stay[0])), np.where(fresh, 1.0, np.exp(stay[1]))

    def sent(clean: np.ndarray, toxic: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        return clean * keep_clean[t] + toxic, clean + toxic * keep_toxic[t]

    clean, toxic = np.repeat([[1.0], [0.0]], lanes, axis=1), np.repeat([[0.0], [1.0]], lanes, axis=1)
    for t in range(long):
        clean, toxic = sent(clean, toxic, t)
        toxic = toxic * weigh[t]
        scale = (clean + toxic).max(axis=0)
        clean, toxic = clean / scale, toxic / scale
    entry, now = np.ones((2, lanes)), (1.0, 1.0)
    for k, (a, b, c, d) in enumerate(zip(clean[0].tolist(), clean[1].tolist(), toxic[0].tolist(), toxic[1].tolist())):
        entry[:, k] = now
        x, y = now[0] * a + now[1] * b, now[0] * c + now[1] * d
        now = (x / (x + y), y / (x + y))
    out, (clean, toxic) = np.zeros((long, lanes)), entry
    for t in range(long):
        clean, toxic = sent(clean, toxic, t)
        out[t] = toxic / clean
        toxic = toxic * weigh[t]
        scale = clean + toxic
        clean, toxic = clean / scale, toxic / scale
    return np.log(out.T.reshape(-1)[:n])


def messages(emission: np.ndarray, first: np.ndarray, stay: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each word from before and from behind."""
    if not len(emission):
        return emission, emission
    last = np.append(first[1:], True)
    return _reach(emission, first, stay), _reach(emission[::-1], last[::-1], stay)[::-1]


class Model:
    def __init__(self, weights: np.ndarray, bias: float, stay: tuple[float, float], calibration: np.ndarray):
        self.weights, self.bias, self.stay, self.calibration = weights, bias, stay, calibration

    def emissions(self, x: Words) -> np.ndarray:
        """Each word's log odds of toxic from its own features and its neighbours'."""
        own, before, after = (self.weights[slots(x.forms[:, NEAR if role else slice(None)], role)].sum(axis=1) for role in range(3))
        out = own[x.form] + self.bias
        out[1:] += np.where(x.first[1:], 0, before[x.form[:-1]])
        out[:-1] += np.where(x.first[1:], 0, after[x.form[1:]])
        return out.astype(np.float64)

    def marginals(self, x: Words) -> np.ndarray:
        e = self.emissions(x)
        ahead, behind = messages(e, x.first, self.stay)
        return 1 / (1 + np.exp(-np.clip(ahead + e + behind, -50, 50)))

    def score(self, x: Words, p: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measures(x, p, n) @ self.calibration, -50, 50)))


def measures(x: Words, p: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` texts: a constant, the largest marginal (as log odds), and logarithms of their sum and their mean."""
    most, total = np.zeros(n), np.bincount(x.text, weights=p, minlength=n)
    np.maximum.at(most, x.text, p)
    most = np.clip(most, 1e-3, 1 - 1e-3)
    mean = total / np.maximum(np.bincount(x.text, minlength=n), 1)
    return np.column_stack([np.ones(n), np.log(most / (1 - most)), np.log(total + 0.05), np.log(mean + 1e-3)])


def spans(x: Words, p: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """Start and end of each run of toxic words of each of ``n`` texts."""
    hot = p >= SPAN
    head = hot & (x.first | ~np.concatenate([[False], hot[:-1]]))
    tail = hot & np.append(x.first[1:] | ~hot[1:], True)[: len(hot)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for text, a, b in zip(x.text[head].tolist(), x.start[head].tolist(), x.end[tail].tolist()):
        out[text].append((a, b))
    return out


def word_labels(x: Words, toxic: np.ndarray) -> np.ndarray:
    """Whether each word is toxic: it stands in a toxic document, and one of its forms is far more frequent in these than in others."""
    marks = x.forms[:, : len(PREFIXES) + 1]
    of, column = np.nonzero(marks)
    names = mix(marks[of, column] + np.uint64(7)) ^ np.where(column == 0, np.uint64(1), np.uint64(0))
    kinds, kind = np.unique(names, return_inverse=True)
    # Each document's distinct forms, then their features, each once.
    held = np.unique(x.text.astype(np.int64) * len(x.forms) + x.form)
    doc, form = held // len(x.forms), held % len(x.forms)
    many = np.bincount(of, minlength=len(x.forms))
    heads = np.cumsum(many) - many
    times = many[form]
    at = np.repeat(heads[form] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    once = np.unique(np.repeat(doc, times) * len(kinds) + kind[at])
    bad = toxic[once // len(kinds)]
    yes, no = (np.bincount(once[flag] % len(kinds), minlength=len(kinds)) for flag in (bad, ~bad))
    n_yes, n_no = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    both = (yes + no) / (n_yes + n_no)
    apart = (yes / n_yes - no / n_no) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_yes + 1 / n_no))
    sure = (yes >= np.maximum(LEAST, LEAST_SHARE * n_yes)) & (apart >= DEVIATIONS) & (yes / n_yes >= RATIO * no / n_no)
    mark = np.zeros(len(x.forms), dtype=bool)
    mark[of[sure[kind]]] = True
    return mark[x.form] & toxic[x.text]


def calibrated(m: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, each halved until it is an improvement."""
    w, sign = np.zeros(m.shape[1]), 2 * y - 1
    loss = lambda v: np.logaddexp(0, -sign * (m @ v)).sum() + 0.5 * ridge * v @ v
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -50, 50)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(len(w)), m.T @ (p - y) + ridge * w)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
    return w


def fit_texts(texts: list[str], toxic: np.ndarray, steps: int = 40, rate: float = 0.25) -> Model:
    """Weights by gradient steps on the log likelihood of the words' labels, then a calibration of the documents' scores."""
    x = Words(texts)
    model = Model(np.zeros(SLOTS, dtype=np.float32), 0.0, (0.0, 0.0), np.zeros(4))
    if len(x.form):
        y = word_labels(x, toxic).astype(np.float64)
        table_, follows = [slots(x.forms[:, NEAR if role else slice(None)], role) for role in range(3)], ~x.first[1:]
        state, moved = np.zeros((2, SLOTS + 3)), np.zeros(SLOTS + 3)
        for step in range(1, steps + 1):
            model.weights, model.bias, model.stay = moved[:SLOTS], float(moved[SLOTS]), (float(moved[-2]), float(moved[-1]))
            e = model.emissions(x)
            ahead, behind = messages(e, x.first, model.stay)
            p = 1 / (1 + np.exp(-np.clip(ahead + e + behind, -50, 50)))
            left, right = (ahead + e)[:-1][follows], (e + behind)[1:][follows]
            logs = np.stack([np.full(len(left), model.stay[0]), right, left, model.stay[1] + left + right])
            odds = np.exp(logs - logs.max(axis=0))
            odds /= odds.sum(axis=0)
            was, now = y[:-1][follows], y[1:][follows]
            residual, g = p - y, np.zeros(SLOTS + 3)
            for role, at in enumerate(table_):
                felt = residual if role == 0 else np.append(np.where(follows, residual[1:], 0), 0) if role == 1 else np.append(0, np.where(follows, residual[:-1], 0))
                per_form = np.bincount(x.form, weights=felt, minlength=len(x.forms))
                g[:SLOTS] += np.bincount(at.ravel(), weights=np.repeat(per_form, at.shape[1]), minlength=SLOTS)
            g[SLOTS] = residual.sum()
            g[-2:] = (odds[0] - (1 - was) * (1 - now)).sum(), (odds[3] - was * now).sum()
            g = g + RIDGE * moved
            state[0], state[1] = 0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g
            moved = moved - rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
            moved[0] = 0.0
            moved[-2:] = np.clip(moved[-2:], -4, 4)
        model.weights, model.bias, model.stay = moved[:SLOTS].astype(np.float32), float(moved[SLOTS]), (float(moved[-2]), float(moved[-1]))
    m = measures(x, model.marginals(x), len(texts))
    model.calibration = calibrated(m, toxic.astype(np.float64))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learned from a bounded sample of labelled documents."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "toxic"), 11) / float(1 << 53)
    usable = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (id_fold("doc_id", 5) != 0)).distinct()
    n = usable.count()
    chosen = usable.withColumn("draw", draw).where(F.col("draw") < 1.5 * sample / max(n, 1)).orderBy("draw", "doc_id").limit(sample)
    # The sample has at most ``sample`` rows of three numbers, so it can be broadcast.
    single = docs.select("doc_id").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").count().where("count = 1").select("doc_id")
    chosen = chosen.join(single, "doc_id").select("doc_id", "toxic", "draw")
    short = F.char_length(F.coalesce("text", F.lit(""))) <= DOC_CHARS
    found = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "draw", "text").collect()
    found = sorted(found, key=lambda r: (r["draw"], r["doc_id"], r["toxic"]))
    found = list({(r["text"], r["toxic"]): r for r in reversed(found)}.values())[::-1]  # a copied text counts once
    found = [r for r, held in zip(found, accumulate(len(r["text"] or "") for r in found)) if held <= CHARS]
    if len({r["toxic"] for r in found}) < 2:
        return Model(np.zeros(SLOTS, dtype=np.float32), -30.0, (0.0, 0.0), np.zeros(4))
    return fit_texts([r["text"] or "" for r in found], np.array([r["toxic"] == 1 for r in found]))


def tag(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxic_score`` and ``toxic_spans`` (start and end in characters)."""

    @F.pandas_udf("toxic_score double, toxic_spans array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        scores, found = [], []
        for block in blocks(texts.fillna("").tolist()):
            x = Words(block)
            p = model.marginals(x)
            scores += model.score(x, p, len(block)).tolist()
            found += [[{"start": a, "end": b} for a, b in one] for one in spans(x, p, len(block))]
        return pd.DataFrame({"toxic_score": scores, "toxic_spans": found})

    kept = docs.drop("toxic_score", "toxic_spans")
    return kept.withColumn("_toxic", run(F.col(text_col))).select(*kept.columns, "_toxic.*")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = tag(docs, fit(docs, table(spark, sf_dir, "labels")))
    places = F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return tagged.select(
        "doc_id", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.array_join(places, ",").alias("spans"),
    )
