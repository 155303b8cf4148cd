"""Phrases found in word sequences by one automaton, and the rewards that steer a decoder towards them."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases up to which one automaton is built and sent to the tasks; reward of a phrase's first word, factor of later ones, reward of other words.
MOST_PHRASES, FIRST, FACTOR, OTHER = 100_000, 1.0, 2.0, 1.0


class Automaton:
    """States are prefixes of phrases; 0 is the empty one. From each, a word leads to the longest prefix that the words so far end with."""

    def __init__(self, phrases: Iterable[Sequence], first: float = FIRST, factor: float = FACTOR, other: float = OTHER):
        self.other = other
        self.next: list[dict] = [{}]
        self.gained, self.depth, self.phrase, self.shorter, self.ending = [0.0], [0], [-1], [0], [0]
        for number, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                if word not in self.next[state]:
                    depth = self.depth[state] + 1
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.depth.append(depth)
                    self.gained.append(self.gained[state] + (first if depth == 1 else first * factor + math.log(depth)))
                    self.phrase.append(-1)
                state = self.next[state][word]
            if state and self.phrase[state] < 0:
                self.phrase[state] = number
        self._link()

    def _link(self) -> None:
        """Per state the longest shorter prefix that its words end with (``shorter``), and the longest such that is a phrase (``ending``)."""
        n = len(self.next)
        self.shorter, self.ending = [0] * n, [0] * n
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for word, child in self.next[state].items():
                back = self.shorter[state]
                while back and word not in self.next[back]:
                    back = self.shorter[back]
                self.shorter[child] = self.next[back].get(word, 0)
                queue.append(child)
            back = self.shorter[state]
            self.ending[state] = back if self.phrase[back] >= 0 else self.ending[back]

    def step(self, state: int, word) -> int:
        while state and word not in self.next[state]:
            state = self.shorter[state]
        return self.next[state].get(word, 0)

    def reward(self, state: int, word) -> tuple[float, int]:
        """What a decoder gains by a word, and the state after it. A prefix that is left pays back what it lent, unless it is a phrase."""
        total = 0.0
        while state and word not in self.next[state]:
            if self.phrase[state] < 0:
                total += self.gained[self.shorter[state]] - self.gained[state]
            state = self.shorter[state]
        after = self.next[state].get(word, 0)
        return total + (self.gained[after] - self.gained[state] if after else self.other), after

    def hits(self, words: Iterable) -> Iterator[tuple[int, int]]:
        """(place of the last word, number of the phrase) of all occurrences, overlapping ones too."""
        state = 0
        for place, word in enumerate(words):
            at = state = self.step(state, word)
            while at:
                if self.phrase[at] >= 0:
                    yield place, self.phrase[at]
                at = self.ending[at]


def words_of(text: Column) -> Column:
    """The runs without white space of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != "")


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, text: str = "text", most: int = MOST_PHRASES) -> DataFrame:
    """(key, phrase, hits): how often each phrase (one column, words joined by blanks) stands in each document.

    Up to ``most`` phrases make one automaton that every task walks its documents through. More
    are joined instead with the word sequences of their lengths, so nothing that grows is broadcast.
    """
    name = phrases.columns[0]
    wanted = phrases.select(F.array_join(words_of(F.col(name)), " ").alias("phrase")).where("phrase <> ''").distinct()
    found = [r["phrase"] for r in wanted.limit(most + 1).collect()]
    rows = docs.select(key, words_of(F.col(text)).alias("ws"))
    if len(found) <= most:
        found = sorted(found)
        automaton = Automaton([p.split(" ") for p in found])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(k, found[p], n) for k, ws in zip(pdf[key], pdf["ws"]) for p, n in Counter(p for _, p in automaton.hits(ws)).items()]
                yield pd.DataFrame(out, columns=[key, "phrase", "hits"])

        return rows.mapInPandas(run, f"{key} long, phrase string, hits long")
    lengths = [r[0] for r in wanted.select(F.size(F.split("phrase", " "))).distinct().collect()]
    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("ws", i, n), " "))
        return F.when(F.size("ws") >= n, made).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*[runs(n) for n in sorted(lengths)]))
    each = rows.select(key, F.explode(every).alias("phrase")).groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("hits"))
    return each.join(wanted, "phrase").select(key, "phrase", "hits")


def boosts(docs: DataFrame, phrases: list[str], key: str, text: str = "text", other: float = 0.0) -> DataFrame:
    """(key, n_words, boost): the sum of all rewards along each document's words. ``phrases`` are a session's few terms."""
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"over {MOST_PHRASES} phrases")
    automaton = Automaton([p.split() for p in sorted(set(phrases))], other=other)

    def total(words: Iterable[str]) -> float:
        state, out = 0, 0.0
        for w in words:
            gain, state = automaton.reward(state, w)
            out += gain
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "n_words": [len(ws) for ws in pdf["ws"]], "boost": [total(ws) for ws in pdf["ws"]]})

    return docs.select(key, words_of(F.col(text)).alias("ws")).mapInPandas(run, f"{key} long, n_words long, boost double")
