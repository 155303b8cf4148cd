"""Galleries that change as meetings pass, and clusters spread from a few seeds to all units."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import merge_gaps, overlap

BIN_US = 4_000_000
STEPS = "group long, policy string, meeting long, seq long, name string, score double, runner_up double, correct boolean, appended boolean"


class Policy(NamedTuple):
    """When a named vector is added to its name's gallery."""

    name: str
    margin: float | None = None
    least_clean: float = 0.0
    sure: bool = False


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def propagated(spans: DataFrame, seeds: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """(key, unit, cluster) of every unit of ``vectors`` (key, unit, v).

    ``seeds`` (key, unit, cluster) keep their cluster. Another unit takes the cluster with whose seeds'
    spans (key, unit, start, end), united, it shares most time; without any, the one whose seeds' mean
    vector its own is most alike to. Ties go to the least cluster; a key without seeds gets null.
    """
    seeded = spans.join(seeds, [key, "unit"])
    united = merge_gaps(seeded.select(key, "cluster", F.col("start").alias("c_start"), F.col("end").alias("c_end")), [key, "cluster"], "c_start", "c_end", 0)
    rest = vectors.join(seeds.select(key, "unit"), [key, "unit"], "left_anti")
    own = merge_gaps(spans.join(rest.select(key, "unit"), [key, "unit"]).select(key, "unit", "start", "end"), [key, "unit"], "start", "end", 0)
    shared = overlap(own, united, [key], ("start", "end"), ("c_start", "c_end"), BIN_US).groupBy(key, "unit", "cluster").agg(F.sum("shared").alias("shared"))
    by_time = shared.groupBy(key, "unit").agg(F.min_by("cluster", F.struct(-F.col("shared"), "cluster")).alias("cluster"))
    left = rest.join(by_time, [key, "unit"], "left_anti")
    means = seeds.join(vectors, [key, "unit"]).select(key, "cluster", F.posexplode("v").alias("i", "x")).groupBy(key, "cluster", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy(key, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    alike = left.join(centres, key).select(key, "unit", "cluster", F.round(dot("v", "c"), 9).alias("s"))
    by_vector = alike.groupBy(key, "unit").agg(F.min_by("cluster", F.struct(-F.col("s"), "cluster")).alias("cluster"))
    found = seeds.select(key, "unit", "cluster").unionByName(by_time).unionByName(by_vector)
    return vectors.select(key, "unit").join(found, [key, "unit"], "left")


def replayed(clusters: DataFrame, gallery: DataFrame, policies: list[Policy], threshold: float) -> DataFrame:
    """Every naming of the clusters (group, meeting, seq, v, clean, true_name), in order of meetings, under every policy.

    ``gallery`` (group, name, v) is what each group starts with; a name's score is its mean cosine with all of
    its vectors, and a cluster below ``threshold`` has no name. Under a policy a named cluster's
    vector is added to its name if the score is ``margin`` above the threshold, ``least_clean`` seconds are clean and, where
    ``sure``, the name is right (no margin: never). Vectors are added when their meeting is over. The gallery
    of a group under a policy is folded in one task: one group's meetings are few.
    """
    rules = {p.name: p for p in policies}
    arm = F.explode(F.array(*[F.lit(name) for name in rules]))
    galleries = gallery.groupBy("group").agg(F.collect_list(F.struct("name", "v")).alias("gallery")).select(F.col("group").alias("of"), "gallery", arm.alias("rule"))

    def run(key: tuple, pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            return pd.DataFrame([], columns=[c.split()[0] for c in STEPS.split(", ")])
        rule, out, known = rules[key[1]], [], {}
        for x in held["gallery"].iloc[0]:
            known.setdefault(x["name"], []).append(np.asarray(x["v"], dtype=np.float64))
        sums = {name: (np.sum(vs, axis=0), len(vs)) for name, vs in known.items()}
        for meeting, rows in pdf.sort_values(["meeting", "seq"]).groupby("meeting", sort=True):
            waiting = []
            for r in rows.itertuples(index=False):
                v = np.asarray(r.v, dtype=np.float64)
                ranked = sorted(((-round(float(v @ s) / n, 9), name) for name, (s, n) in sums.items()))
                score, name = -ranked[0][0], ranked[0][1]
                if score < threshold:
                    continue
                right = name == r.true_name
                add = rule.margin is not None and score >= threshold + rule.margin and r.clean >= rule.least_clean and (right or not rule.sure)
                out.append((key[0], key[1], meeting, r.seq, name, score, -ranked[1][0] if len(ranked) > 1 else None, right, add))
                if add:
                    waiting.append((name, v))
            for name, v in waiting:
                s, n = sums[name]
                sums[name] = (s + v, n + 1)
        return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")])

    each = clusters.select("group", "meeting", "seq", "v", "clean", "true_name", arm.alias("policy"))
    return each.groupBy("group", "policy").cogroup(galleries.groupBy("of", "rule")).applyInPandas(run, STEPS)


def policy_summary(steps: DataFrame) -> DataFrame:
    """(policy, added_right, added_wrong, left_right, left_wrong)"""
    named = {"added_right": "appended and correct", "added_wrong": "appended and not correct", "left_right": "not appended and correct", "left_wrong": "not appended and not correct"}
    return steps.groupBy("policy").agg(*[F.count_if(F.expr(cond)).alias(name) for name, cond in named.items()])


def fold_steps(clusters: DataFrame, least: float) -> DataFrame:
    """(key, step, a, b, score, same) of a fold that merges the two clusters of a key (key, label, v, seconds, true_name) that are most alike, while they are at least ``least`` alike.

    A union's vector is the mean weighted by seconds, its name that of the part with more. ``same`` tells whether both parts bear one name.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        live = {r.label: [np.asarray(r.v, dtype=np.float64), float(r.seconds), r.true_name] for r in pdf.sort_values("label").itertuples(index=False)}
        out = []
        while len(live) > 1:
            unit = {k: x[0] / max(np.linalg.norm(x[0]), 1e-10) for k, x in live.items()}
            names = sorted(live)
            m = np.round(np.array([unit[k] for k in names]) @ np.array([unit[k] for k in names]).T, 9)
            m[np.tril_indices(len(names))] = -2
            i, j = divmod(int(m.argmax()), len(names))
            if m[i, j] < least:
                break
            a, b = names[i], names[j]
            (x, s, p), (y, t, q) = live[a], live.pop(b)
            out.append((pdf["key"].iloc[0], len(out), a, b, float(m[i, j]), p == q))
            live[a] = [(x * s + y * t) / max(s + t, 1e-10), s + t, p if s >= t else q]
        return pd.DataFrame(out, columns=["key", "step", "a", "b", "score", "same"])

    return clusters.select("key", "label", "v", "seconds", "true_name").groupBy("key").applyInPandas(run, "key long, step int, a string, b string, score double, same boolean")
