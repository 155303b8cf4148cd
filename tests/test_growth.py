"""Work that follows the input: no row per pair of vectors, no file per agent."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import matching, measures, records, voices, windows
from parlance.plans import measures as plans
from parlance.plans import scoring
from parlance.sources import annotations


def test_files_follow_partitions_not_agents(spark, tmp_path):
    rows = spark.range(0, 600, 1, 3).select(
        F.concat(F.lit("m:"), F.col("id") % 7).alias("meeting"), F.col("id").cast("string").alias("agent"), F.col("id"), F.lit(0.5).alias("start"), F.lit(1.0).alias("end"), F.lit(False).alias("punc"), F.lit("w").alias("text")
    )
    annotations.write_words(rows, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("part-*"))) <= 3
    got = {(r.meeting, r.agent) for r in annotations.annotated_words(spark, str(tmp_path / "out")).collect()}
    assert got == {(f"m:{i % 7}", str(i)) for i in range(600)}


def vectors(spark, n, seed, name, v):
    """Vectors of which many are copies or differ by very little, one is null, one holds a null and one is shorter."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n // 3, 6))
    rows = [(i, [float(x) for x in base[i % len(base)] * (1 + 1e-13 * (i % 2))]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (n + 2, [1.0, 2.0])]
    return spark.createDataFrame([("m" if i % 2 else "k", i, i // 10, x) for i, x in rows], f"model string, {name} long, group long, {v} array<double>").withColumn(v, voices.unit(v))


@pytest.mark.parametrize("apart", [False, True])
def test_highest_scores_are_those_of_all_pairs(spark, monkeypatch, apart):
    monkeypatch.setattr(voices, "BLOCK", 16)
    trials, profiles = vectors(spark, 60, 1, "trial", "v"), vectors(spark, 90, 1, "profile", "p")
    pairs = trials.select("model", "trial", F.col("group").alias("a"), "v").join(profiles.select("model", "profile", F.col("group").alias("b"), "p"), "model")
    every = (pairs.where("a <> b") if apart else pairs).select("trial", "profile", voices.dot("v", "p").alias("score")).where("score is not null")
    want = {r.trial: (r.profile, r.score) for r in voices.best_match(every, -2.0).collect()}
    found = voices.highest_scores(trials, profiles, apart=apart)
    got = {r.trial: (r.profile, r.score) for r in voices.best_match(found, -2.0).collect()}
    assert {t: x for t, x in got.items() if x != (None, None)} == want and set(got) == {r.trial for r in trials.collect()}
    assert found.where("score is not null").count() <= 63 * 6 < every.count()
    near = {(r.trial, r.profile) for r in voices.highest_scores(trials, profiles.where("profile >= 60"), within=0.5, apart=apart).where("score is not null").collect()}
    kept = every.where("profile >= 60")
    top = kept.groupBy("trial").agg(F.max("score").alias("top"))
    assert near >= {(r.trial, r.profile) for r in kept.join(top, "trial").where("score > top - 0.5").collect() if r.profile < 90}


def test_means_of_groups_and_profiles(spark):
    trials, profiles = vectors(spark, 60, 1, "trial", "v").where("trial < 60"), vectors(spark, 90, 2, "profile", "p").where("profile < 90")
    pairs = trials.withColumnRenamed("group", "a").join(profiles.withColumnRenamed("group", "b"), "model").select("trial", "profile", (F.col("a") == F.col("b")).alias("same_group"), voices.dot("v", "p").alias("score"))
    want = {r.same_group: (r.n, r.s) for r in pairs.groupBy("same_group").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("s")).collect()}
    got = {r.same_group: (r.n, r.mean_score) for r in voices.group_means(trials, profiles).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and all(got[k][1] == pytest.approx(s, abs=1e-12) for k, (_, s) in want.items())
    wide = profiles.withColumn("profile", F.expr("profile div 4"))
    want = {(r.trial, r.profile): r.s for r in pairs.groupBy("trial", F.expr("profile div 4").alias("profile")).agg(F.avg("score").alias("s")).collect()}
    got = voices.scores(trials, voices.mean_profiles(wide)).collect()
    assert len(got) == len(want) and all(r.score == pytest.approx(want[r.trial, r.profile], abs=1e-12) for r in got)


def test_hours_take_seconds_to_the_nearest(spark, tmp_path):
    con = duckdb.connect()
    con.sql(
        "CREATE TABLE events AS SELECT i AS event_id, i % 3 AS user_id, TIMESTAMP '2024-01-01 00:59:59' + INTERVAL (i * 3600) SECOND + INTERVAL (i * 130) MILLISECOND AS ts, 'view' AS event_type, 1.0 + i % 4 AS value FROM range(40) t(i)"
    )
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in plans.wn20_dominant_spans(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(plans.ORACLE_SQL["wn20_dominant_spans"]).fetchall())


def test_coverage_is_bounded_by_the_common_letters(spark):
    draw = random.Random(3)
    for _ in range(300):
        a, b = ("".join(draw.choices("abc ", k=draw.randrange(14))) for _ in range(2))
        b = draw.choice([b, a, b[:3] + a + b[3:], a[:4] + b[:2] + a[4:]])
        share = matching.covered(a, b)
        assert not a or matching.common_length(a, b) >= round(share * len(a) - 1e-9)
        assert all(matching.covers(a, b, least) == (share >= least) for least in (0.3, 0.5, 0.8, 1.0))
    assert matching.common_length("abcbdab", "bdcaba") == 4
    met = []
    plain = matching.covered
    try:
        matching.covered = lambda *x: met.append(x)
        assert not matching.covers("the first of many words", "something else at all", 0.8) and matching.covers("of many", "the first of many words", 0.8)
    finally:
        matching.covered = plain
    assert not met


def test_steps_and_turns_are_spread(spark, tmp_path):
    rows = [(1, "a b c".split(), "a x c d".split()), (2, [], ["a"]), (3, ["a"], []), (4, [], []), (5, ["é", "b"], ["é", "b"])]
    got = {r.k: [tuple(s) for s in r.s] for r in spark.createDataFrame(rows, "k int, a array<string>, b array<string>").select("k", matching.align("a", "b").alias("s")).collect()}
    assert got == {k: matching.aligned(a, b) for k, a, b in rows}
    turns = [(i, 0, "user", "one two three") for i in range(40)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert scoring._pairs(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_captions_need_no_call_for_each_part(spark):
    words = [(c, i, "w" * (1 + (i * 7 + c) % 30), i * 400_000 + (i // 25) * 2_000_000, i * 400_000 + (i // 25) * 2_000_000 + 300_000) for c in range(3) for i in range(100)]
    made = records.caption_lines(spark.createDataFrame(words, "channel long, seq long, text string, start_us long, end_us long"), most_chars=60)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    want, held = set(), {}
    for c, i, text, _, _ in words:
        line, chars = held.get((c, i // 25), (0, 0))
        want.add((c, i // 25 + 1, i, line))
        chars += len(text) + (chars > 0)
        held[c, i // 25] = (line + 1, 0) if chars >= 60 else (line, chars)
    assert {tuple(r) for r in made.select("channel", "part", "seq", "line").collect()} == want


def test_devices_of_one_name(spark):
    devices = spark.createDataFrame([(f"d{i}", "same" if i else "one") for i in range(50)], "id string, name string")
    asks = spark.createDataFrame([(i, n) for i, n in enumerate(["same"] * 50 + ["one", "d7", "none"])], "ask long, name string")
    got = {r.ask: (r.id, r.problem) for r in measures.matched_devices(asks, devices).collect()}
    assert got == {**{i: (None, "ambiguous") for i in range(50)}, 50: ("d0", None), 51: ("d7", None), 52: (None, "unknown")}


def test_cues_of_many_entries(spark):
    rows = [(1, "a", [(0, 10, "x"), (10, 20, "é" * 82), (20, 30, "z"), (2_000_000, 2_000_010, "late")]), (2, "b", []), (3, "c", None), (4, "d", [(5, 6, "w")])]
    entries = spark.createDataFrame(rows, "k long, speaker string, ws array<struct<start_us: long, end_us: long, text: string>>")
    got = [tuple(r) for r in windows.cues(entries, ["k"]).orderBy("k", "seq").collect()]
    assert got == [(1, "a", 0, 0, 20, "x " + "é" * 82), (1, "a", 1, 20, 30, "z"), (1, "a", 2, 2_000_000, 2_000_010, "late"), (4, "d", 0, 5, 6, "w")]
