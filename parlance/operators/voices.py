"""Voice embeddings: scores against profiles, thresholds, and clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Trials that are broadcast at once (64 coordinates each: about 30 MB), and parts of the profiles beyond that.
QUERIES, SALTS = 50_000, 256
ACCEPT, COLLAPSE, FOLD = 0.56, 0.6, 0.8
#: Trials, and profiles, whose matrices are multiplied by one task; trials that are multiplied at once (64 coordinates each: 4 MB and 16 MB).
BLOCK, STRIP = 8192, 256


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # The norm is an element of its own so that it is not worked out again for each coordinate.
    return F.transform(F.array(norm), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))[0]


def scores(trials: DataFrame, profiles: DataFrame) -> DataFrame:
    """The cosine of each trial (model, trial, v) with each profile (model, profile, p) of the same model.

    Trials are the query set. Up to ``QUERIES`` of them are broadcast to the profiles; more are
    dealt to blocks of that size, and profiles to ``SALTS`` parts, so that no model is one task.
    """
    blocks = -(-trials.count() // QUERIES)
    if blocks <= 1:
        both = profiles.join(F.broadcast(trials), "model")
    else:
        dealt = trials.withColumn("_block", F.pmod(F.xxhash64("trial"), F.lit(blocks))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = profiles.withColumn("_salt", F.pmod(F.xxhash64("profile"), F.lit(SALTS)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        both = parts.join(dealt, ["model", "_block", "_salt"])
    return both.select("trial", "profile", dot("v", "p").alias("score"))


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists in ``column`` the places of those with finite coordinates only, and these as a matrix."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    out = {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == n)
        v = column.take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
        known = np.isfinite(v).all(axis=1)
        out[n] = at[known], np.ascontiguousarray(v[known])
    return out


def _highest(v: np.ndarray, p: np.ndarray, v_group: np.ndarray, p_group: np.ndarray, within: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``v`` and ``p`` of the pairs whose product is at most ``within`` below the greatest of the row of ``v``, and the product; the first of equals alone if ``within`` is 0. Negative groups are of nobody else."""
    # Products of matrices are right up to rounding, so that near ones are worked out again in the order of ``dot``.
    slack = within + 1e-9 * np.linalg.norm(v, axis=1) * np.linalg.norm(p, axis=1).max(initial=0.0)
    for start in range(0, len(v), STRIP):
        product = v[start : start + STRIP] @ p.T
        mine = v_group[start : start + STRIP]
        if (mine >= 0).any():
            product[(mine[:, None] == p_group[None, :]) & (mine >= 0)[:, None]] = -np.inf
        least = product.max(axis=1, initial=-np.inf) - slack[start : start + STRIP]
        i, j = np.nonzero((product >= least[:, None]) & (product > -np.inf))
        i += start
        exact = np.zeros(len(i))
        for k in range(v.shape[1]):
            exact += v[i, k] * p[j, k]
        if within == 0:
            order = np.lexsort((j, -exact, i))
            first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            i, j, exact = i[first], j[first], exact[first]
        yield i, j, exact


def highest_scores(trials: DataFrame, profiles: DataFrame, within: float = 0.0, apart: bool = False) -> DataFrame:
    """Of ``scores`` those rows that can be a trial's best, or lie at most ``within`` below it, for ``best_match``; a trial that has none of them has a row of nulls.

    All pairs are compared, but none is a row: blocks of trials meet parts of the profiles, and a task multiplies the two
    matrices and hands on the best of each trial. Of profiles with the same vector only the first is compared. With
    ``apart`` both sides have a long ``group`` of 0 or more, and pairs of one group do not count. Vectors that are null, or hold nulls or numbers
    that are not finite, have no score, and nor do pairs of different lengths.
    """
    blocks, parts = (max(1, -(-df.count() // BLOCK)) for df in (trials, profiles))
    group = F.col("group") if apart else F.lit(-1).cast("long")
    dealt = lambda df, c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = trials.select("model", "trial", F.col("v").alias("_v"), group.alias("group"), dealt(trials, "trial", blocks).alias("_block"), every(parts).alias("_part"))
    right = profiles.select("model", "profile", F.col("p").alias("_v"), group.alias("group"), every(blocks).alias("_block"), dealt(profiles, "profile", parts).alias("_part"))
    schema = T.StructType([T.StructField("trial", trials.schema["trial"].dataType), T.StructField("profile", profiles.schema["profile"].dataType), T.StructField("score", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("profile")
        x, y = _matrices(a.column("_v")), _matrices(b.column("_v"))
        groups = [t.column("group").to_numpy() for t in (a, b)]
        at, to, score = [np.arange(a.num_rows if b.num_rows else 0)], [np.full(a.num_rows if b.num_rows else 0, -1)], [np.full(a.num_rows if b.num_rows else 0, np.nan)]
        for n in x.keys() & y.keys():
            (rows, v), (cols, p) = x[n], y[n]
            whole = np.column_stack([p, groups[1][cols].astype(np.float64)])
            first = np.sort(np.unique(whole.view(f"V{whole.shape[1] * 8}").ravel(), return_index=True)[1])
            cols, p = cols[first], p[first]
            for i, j, s in _highest(v, p, groups[0][rows], groups[1][cols], within):
                at.append(rows[i])
                to.append(cols[j])
                score.append(s)
        at, to, score = (np.concatenate(c) for c in (at, to, score))
        none = to < 0
        found = b.column("profile").combine_chunks().take(pa.array(to, mask=none))
        return pa.table({"trial": a.column("trial").combine_chunks().take(pa.array(at)), "profile": found, "score": pa.array(score, mask=none)})

    keys = ["model", "_block", "_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def mean_profiles(profiles: DataFrame) -> DataFrame:
    """(model, profile, p): the mean of a profile's vectors, of which each has a few. Its score is the mean of their scores."""
    added = F.aggregate("_all", F.transform(F.col("_all")[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return profiles.groupBy("model", "profile").agg(F.collect_list("p").alias("_all")).select("model", "profile", F.transform(added, lambda x: x / F.size("_all")).alias("p"))


def group_means(trials: DataFrame, profiles: DataFrame) -> DataFrame:
    """(same_group, n, mean_score) of all pairs of a model: how many are of the same ``group`` or of two, and their mean score.

    A sum of products of all pairs is the product of the sums, so each side is added up by group once.
    """

    def sums(df: DataFrame, v: str, name: str) -> DataFrame:
        every = df.select("model", "group", F.posexplode(v).alias("i", "x")).groupBy("model", "group", "i").agg(F.sum("x").alias("x"))
        return every.select("model", "group", "i", F.col("x").alias(name))

    def pairs(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
        return a.join(b, key).select((F.col("a") * F.col("b")).alias("s"))

    ways = []
    for keys in (["model", "group"], ["model"]):
        t, p = (sums(df, v, name).groupBy(*keys, "i").agg(F.sum(name).alias(name)) for df, v, name in ((trials, "v", "a"), (profiles, "p", "b")))
        total = pairs(t, p, [*keys, "i"]).agg(F.sum("s").alias("s"))
        n, known = (
            pairs(trials.groupBy(*keys).agg(F.count(a).alias("a")), profiles.groupBy(*keys).agg(F.count(b).alias("b")), keys).agg(F.coalesce(F.sum("s"), F.lit(0)).alias(name))
            for name, a, b in (("n", F.lit(1), F.lit(1)), ("known", "v", "p"))
        )
        ways.append(total.crossJoin(n).crossJoin(known))
    same, every = ways
    other = same.select(F.col("s").alias("_s"), F.col("n").alias("_n"), F.col("known").alias("_k")).crossJoin(every).select((F.col("s") - F.coalesce("_s", F.lit(0.0))).alias("s"), (F.col("n") - F.col("_n")).alias("n"), (F.col("known") - F.col("_k")).alias("known"))
    both = same.withColumn("same_group", F.lit(True)).unionByName(other.withColumn("same_group", F.lit(False)))
    return both.where("n > 0").select("same_group", "n", F.when(F.col("known") > 0, F.col("s") / F.col("known")).alias("mean_score"))


def best_match(scored: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """The best profile per trial, the first of equals; null below the threshold."""
    rank = F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), "profile"))
    top = scored.groupBy("trial").agg(F.min_by("profile", rank).alias("profile"), F.max("score").alias("score"))
    return top.select("trial", F.when(F.col("score") >= threshold, F.col("profile")).alias("profile"), "score")


def weighted_mean(rows: DataFrame, key: list[str], v: str, weight: str) -> DataFrame:
    """The unit vector of each key's weighted sum."""
    parts = rows.select(*key, weight, F.posexplode(v).alias("i", "x")).groupBy(*key, "i").agg(F.sum(F.col("x") * F.col(weight)).alias("x"))
    return parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).withColumn("v", unit("v"))


def collapse(clusters: DataFrame, threshold: float = COLLAPSE) -> DataFrame:
    """Per channel of (channel, label, v): whether all pairs are alike, every cluster has a vector, and there are two or more."""
    a, b = (clusters.select("channel", F.col("label").alias(f"label_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    pairs = a.join(b, "channel").where("label_a < label_b and v_a is not null and v_b is not null").groupBy("channel").agg(F.min(dot("v_a", "v_b")).alias("least"))
    sizes = clusters.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_vectors"))
    one = (F.col("n") >= 2) & (F.col("n") == F.col("n_vectors")) & (F.coalesce("least", F.lit(-1.0)) >= threshold)
    return sizes.join(pairs, "channel", "left").select("channel", "n", "least", one.alias("collapse"))


def fold(clusters: DataFrame, wanted: int, gate: float = FOLD) -> DataFrame:
    """Per channel of (channel, label, seconds, v): (channel, label, into) after clusters were merged until ``wanted`` are left.

    The most alike pair is merged if it reaches the gate, else the shortest cluster with its most
    alike; the longer keeps its label. A channel has a handful of clusters, so a group is small.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seconds = dict(zip(pdf["label"], pdf["seconds"]))
        vectors = {k: list(v) for k, v in zip(pdf["label"], pdf["v"]) if v is not None}
        into = {k: k for k in seconds}
        alike = lambda x, y: sum(p * q for p, q in zip(vectors[x], vectors[y]))
        while len(seconds) > wanted and len(vectors) >= 2:
            names = list(seconds)
            pairs = [(alike(x, y), x, y) for i, x in enumerate(names) for y in names[i + 1 :] if x in vectors and y in vectors]
            score, a, b = max(pairs)
            if score < gate:
                b = min((c for c in names if c in vectors), key=seconds.get)
                a = max((c for c in names if c in vectors and c != b), key=lambda c: alike(c, b))
            keep, gone = (a, b) if seconds[a] >= seconds[b] else (b, a)
            mixed = [p * seconds[keep] + q * seconds[gone] for p, q in zip(vectors[keep], vectors[gone])]
            length = math.sqrt(sum(x * x for x in mixed))
            vectors[keep] = [x / length for x in mixed] if length else mixed
            seconds[keep] += seconds.pop(gone)
            del vectors[gone]
            into = {k: keep if v == gone else v for k, v in into.items()}
        return pd.DataFrame({"channel": pdf["channel"], "label": pdf["label"], "into": [into[k] for k in pdf["label"]]})

    ordered = clusters.select("channel", "label", "seconds", "v")
    return ordered.groupBy("channel").applyInPandas(lambda p: run(p.sort_values("label")), "channel long, label string, into string")


def rates(scored: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Detection, false alarm and false reject rates of trials (trial, known profile or null) at a threshold."""
    top = best_match(scored, -2.0).join(truth, "trial")
    accepted, known = F.col("score") >= threshold, F.col("true_profile").isNotNull()
    right = accepted & (F.col("profile") == F.col("true_profile"))
    return top.agg(
        F.round(F.avg(F.when(known, right.cast("double"))), 6).alias("dir"), F.round(F.avg(F.when(~known, accepted.cast("double"))), 6).alias("far"),
        F.round(F.avg(F.when(known, (~accepted).cast("double"))), 6).alias("frr"),
    )


def curve(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """The same rates at every distinct top score, from running counts. One ordered pass over one row per distinct score."""
    top = best_match(scored, -2.0).join(truth, "trial").withColumn("score", F.round("score", 4))
    known = F.col("true_profile").isNotNull()
    per = top.groupBy("score").agg(F.count_if(known & (F.col("profile") == F.col("true_profile"))).alias("right"), F.count_if(known).alias("known"), F.count_if(~known).alias("strangers"))
    down = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = per.agg(F.sum("known").alias("all_known"), F.sum("strangers").alias("all_strangers"))
    rows = per.select("score", F.sum("right").over(down).alias("right"), F.sum("known").over(down).alias("known"), F.sum("strangers").over(down).alias("strangers")).join(F.broadcast(totals))
    rate = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    return rows.select("score", rate("right", "all_known").alias("dir"), rate("strangers", "all_strangers").alias("far"), F.round(1 - F.col("known") / F.nullif(F.col("all_known"), F.lit(0)), 6).alias("frr"))
