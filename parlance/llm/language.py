"""Language identification in two steps: first the family, then one-versus-one linear support
vector machines between the languages of that family.

Features are hashed counts of the 1- to 4-byte sequences of the lower-cased UTF-8 text, square
rooted and scaled to length 1. Machines are fitted by gradient steps on the squared hinge loss.

Training rows are those whose id's crc32 modulo 5 is not 0, with a language and a text with
letters; at most ``PER_LANGUAGE`` of them for each language are used, and ``TRAINING`` in all (fewer
of each where there are many languages; none is left out), chosen by the smallest hash of id and
text. One task learns from this sample. Predictions read the whole text and nothing else.

A text with ``SURE_LENGTH`` characters or more in words of letters is in no language that was learned if its
sequences are too unlikely there: the mean logarithm of each sequence's share in the language that has it most is
below a floor. The floor lies between what half of the training texts score under the other half, and what is no
language that was learned scores: texts with their letters shuffled, and those of each language under all others. (It is the ``LOW``
quantile of the first where both overlap, so that texts in learned languages stay.) Such a text
still gets a prediction, but ``lang_known`` is false. Shorter texts show too little to be rejected so.

Null texts and texts without letters are ``und`` with score 0 and not known; when there are no
training rows everything is ``und``, and known if it has letters. A null id is neither held out nor learned from. Repeated rows each get a row.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, id_fold, map_chunks, mix, table

DIMENSIONS, PER_LANGUAGE, TRAINING, SEED = 1 << 13, 400, 12_000, 4
UNDECIDED = "und"
#: Characters from which a text can be told to be in no learned language; quantiles of texts in and out of learned languages; smoothing of shares.
SURE_LENGTH, LOW, HIGH, SMOOTH = 80, 0.002, 0.98, 1e-4
#: Languages up to which their table is broadcast.
MANY = 10_000
LETTER, DIGIT, OTHERS = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[\W_]+")
_SIGNS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
# Language families by ISO 639-1 code. A code that is missing here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "indic": "hi ur bn mr gu pa ne",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def has_letter(text: str | None) -> bool:
    """Digits of any form, such as fractions and circled numbers, are no letters."""
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def counts(text: str) -> np.ndarray:
    """Hashed counts of the byte sequences of a text."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    h = x
    for n in range(1, 5):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        if len(h):
            total += np.bincount(((h + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=DIMENSIONS)
    return total


def in_words(text: str) -> str:
    """The runs of letters of a text that no digit touches."""
    words = text.translate(_SIGNS).split()
    return " ".join([w if w.isalpha() else OTHERS.sub(" ", w).strip() for w in words if w.isalpha() or not DIGIT.search(w)])


def shuffled(text: str) -> str:
    """The text with its letters and blanks in an order that only depends on it."""
    order = np.argsort(mix(np.arange(len(text), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    return "".join(text[i] for i in order.tolist())


def pack(total: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(total, 65535).astype("<u2").tobytes(), 1)


def compact(data: bytes) -> np.ndarray:
    """Packed counts as they were packed, in 16 bits each."""
    return np.frombuffer(zlib.decompress(data), dtype="<u2")


def unpack(data: bytes) -> np.ndarray:
    return compact(data).astype(np.int64)


class Profile:
    """How well texts fit learned languages: ``share`` has for every sequence the logarithm of its share in the language that has it most."""

    def __init__(self, shares: dict[str, np.ndarray], without: str | None = None):
        kept = [v for lang, v in shares.items() if lang != without]
        self.share = np.log(np.max(kept, axis=0)).astype(np.float32) if kept else None

    def fit_of(self, total: np.ndarray) -> float:
        total = total.astype(np.int64)
        return float(total @ self.share) / max(1, int(total.sum()))


def shares_of(rows: list[tuple[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Smoothed shares of the sequences in each language; every text counts the same."""
    out: dict[str, np.ndarray] = {}
    for lang, total in rows:
        total = total.astype(np.int64)
        out[lang] = out.get(lang, 0) + total / max(1, total.sum())
    return {lang: (v / v.sum() + SMOOTH / DIMENSIONS) / (1 + SMOOTH) for lang, v in out.items() if v.sum() > 0}


def calibrated(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[np.ndarray | None, float]:
    """The profile's logarithms and the floor, from (language, counts, counts of the shuffled text) of training texts. Counts may be of any whole numbers; they are widened one text at a time."""
    halves, inside, outside = (rows[::2], rows[1::2]), [], []
    for one, other in (halves, halves[::-1]):
        shares = shares_of([(lang, total) for lang, total, _ in one])
        if not shares:
            continue
        whole, less = Profile(shares), {lang: Profile(shares, lang) for lang in shares} if len(shares) > 1 else {}
        inside += [whole.fit_of(total) for lang, total, _ in other if lang in shares]
        outside += [whole.fit_of(noise) for _, _, noise in other]
        outside += [less[lang].fit_of(total) for lang, total, _ in other if lang in less]
    shares = shares_of([(lang, total) for lang, total, _ in rows])
    if not inside or not shares:
        return None, -np.inf
    low, high = float(np.quantile(inside, LOW)), float(np.quantile(outside, HIGH))
    return Profile(shares).share, (low + high) / 2 if high < low else low


def features(total: np.ndarray) -> np.ndarray:
    x = np.sqrt(total, dtype=np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_machine(x: np.ndarray, y: np.ndarray, steps: int = 150, cost: float = 20.0) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, no offset) for labels -1 and 1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = momentum = np.zeros(x.shape[1], dtype=np.float32)
    rate = 1.0 / (1.0 + 2.0 * cost)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ momentum))
        new = momentum - rate * (momentum - 2.0 * cost * ((share * y * slack) @ x))
        momentum, w = new + (step / (step + 3)) * (new - w), new
    return w


class Model:
    """Families with a machine each (one against the rest), and a machine for each pair of languages within."""

    def __init__(self, x: np.ndarray, langs: list[str], novelty: tuple[np.ndarray | None, float] = (None, -np.inf)):
        self.members: dict[str, list[str]] = defaultdict(list)
        for lang in sorted(set(langs)):
            self.members[FAMILY_OF.get(lang, lang)].append(lang)
        self.families = sorted(self.members)
        of = np.array([self.families.index(FAMILY_OF.get(c, c)) for c in langs])
        which = np.array(langs)
        sign = lambda flags: np.where(flags, 1, -1).astype(np.float32)
        rows = [fit_machine(x, sign(of == k)) for k in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs: dict[str, list[tuple[int, int, int]]] = {}
        for family in self.families:
            self.pairs[family] = []
            for (i, a), (j, b) in combinations(enumerate(self.members[family]), 2):
                both = (which == a) | (which == b)
                self.pairs[family].append((i, j, len(rows)))
                rows.append(fit_machine(x[both], sign(which[both] == a)))
        self.weights = np.array(rows, dtype=np.float32).reshape(len(rows), x.shape[1] if len(x) else DIMENSIONS)
        self.share, self.floor = novelty

    def known(self, text: str) -> bool:
        """Whether the text may be in a learned language."""
        if self.share is None or len(plain := in_words(text)) < SURE_LENGTH:
            return True
        total = counts(plain)
        return float(total @ self.share) / max(1, int(total.sum())) >= self.floor

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text is in a language that was learned."""
        if not self.families or not has_letter(text):
            return UNDECIDED, 0.0, not self.families and has_letter(text)
        margins = self.weights @ features(counts(text)) if len(self.weights) else np.zeros(0)
        sure = lambda m: 1.0 / (1.0 + np.exp(-6.0 * m))
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            best = int(np.argmax(margins[: len(self.families)]))
            family, score = self.families[best], float(sure(margins[best]))
        votes = np.zeros(len(self.members[family]))
        for i, j, k in self.pairs[family]:
            votes[i] += 1 + np.tanh(margins[k]) if margins[k] >= 0 else 0
            votes[j] += 1 - np.tanh(margins[k]) if margins[k] < 0 else 0
        top = int(np.argmax(votes))
        for i, j, k in self.pairs[family]:
            if top in (i, j):
                score *= float(sure(margins[k] if top == i else -margins[k]))
        return self.members[family][top], score, self.known(text)


def fit(docs: DataFrame) -> Model:
    """The model learned from a bounded sample of ``docs`` (doc_id, text, lang)."""
    usable = docs.where(F.col("lang").isNotNull() & (id_fold("doc_id", 5) != 0))
    found = usable.groupBy("lang").count()
    languages = found.count()
    if not languages:
        return Model(np.zeros((0, DIMENSIONS), dtype=np.float32), [])
    each = max(1, min(PER_LANGUAGE, TRAINING // languages))
    limits = found.select("lang", (1.5 * each / F.col("count")).alias("share"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) / float(1 << 53)
    drawn = usable.where(F.col("text").isNotNull()).select("lang", draw.alias("draw"), "text")
    chosen = (drawn.join(F.broadcast(limits), "lang") if languages <= MANY else drawn.join(limits, "lang")).where("draw < share")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[has_letter(t) for t in pdf["text"]]]
        plain = [in_words(t) for t in pdf["text"]]
        long = [p if len(p) >= SURE_LENGTH else None for p in plain]
        return pd.DataFrame({
            "lang": pdf["lang"], "draw": pdf["draw"], "packed": [pack(counts(t)) for t in pdf["text"]],
            "plain": [p and pack(counts(p)) for p in long], "noise": [p and pack(counts(shuffled(p))) for p in long],
        })

    made = map_chunks(chosen.select("lang", "draw", "text"), run, "lang string, draw double, packed binary, plain binary, noise binary")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fitted([r for batch in batches for r in batch.itertuples(index=False)], each)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})
        del model
        give_back()

    # One task learns from the sample, so that the driver holds no more than the weights.
    learned = made.repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(learned[0]["model"]) if learned else fitted([], each)


def fitted(rows: list, each: int) -> Model:
    """The model learned from the first ``each`` rows (lang, draw, packed, plain, noise) of each language."""
    per: dict[str, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.draw, bytes(r.packed))):
        if len(per[r.lang]) < each:
            per[r.lang].append(r)
    kept = [r for lang in sorted(per) for r in per[lang]]
    del rows, per
    novelty = calibrated([(r.lang, compact(r.plain), compact(r.noise)) for r in kept if r.plain is not None])
    x = np.empty((len(kept), DIMENSIONS), dtype=np.float32)
    for i, r in enumerate(kept):
        x[i] = features(unpack(r.packed))
    return Model(x, [r.lang for r in kept], novelty)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_known``; columns of these names are replaced."""

    @F.pandas_udf("lang_pred string, lang_score double, lang_known boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "lang_score", "lang_known"])

    kept = docs.drop("lang_pred", "lang_score", "lang_known")
    return kept.withColumn("_lang", run(F.col(text_col))).select(*kept.columns, "_lang.*")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang"))).select(
        "doc_id", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
