"""Clusters, phrases, signals, changing galleries and annotation files against plain definitions."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import clusters, records, signals, terms, updates
from parlance.sources import annotations


def unit(rng, n, dim=5):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distance(v, a, b, method):
    """Of two clusters, from their members."""
    if method == "complete":
        return max(1 - v[i] @ v[j] for i in a for j in b)
    if method == "average":
        return np.mean([1 - v[i] @ v[j] for i in a for j in b])
    apart = np.linalg.norm(v[a].mean(axis=0) - v[b].mean(axis=0))
    return apart if method == "centroid" else math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * apart


def plain_hierarchy(v, method, threshold=None, count=None):
    groups = [[i] for i in range(len(v))]
    while len(groups) > (count or 1):
        d, i, j = min((round(distance(v, a, b, method), 9), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if threshold is not None and d >= threshold:
            break
        groups[i] = groups[i] + groups.pop(j)
    order = sorted(groups, key=min)
    return [next(k for k, g in enumerate(order) if i in g) for i in range(len(v))]


@pytest.mark.parametrize("method", clusters.LINKAGES)
def test_linkages_by_definition(method):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 17):
        v = unit(rng, n)
        for count in (1, 2, 5, 40):
            assert clusters.hierarchy(v, method, count=count).tolist() == plain_hierarchy(v, method, count=count)
        for threshold in (0.0, 0.3, 0.7, 1.1, 3.0):
            assert clusters.hierarchy(v, method, threshold=threshold).tolist() == plain_hierarchy(v, method, threshold=threshold)
    assert clusters.hierarchy(np.zeros((0, 3)), method, count=2).tolist() == []
    same = np.ones((4, 3))
    assert clusters.hierarchy(same, method, threshold=0.1).tolist() == [0] * 4


def test_linkage_needs_one_rule():
    for how in ({}, {"threshold": 0.1, "count": 2}):
        with pytest.raises(ValueError):
            clusters.hierarchy(np.ones((2, 2)), "ward", **how)
    with pytest.raises(ValueError):
        clusters.hierarchy(np.ones((2, 2)), "single", count=1)


def test_many_vectors_take_no_cubic_loop():
    v = unit(np.random.default_rng(1), 800, 16)
    began = time.time()
    assert len(set(clusters.hierarchy(v, "ward", count=12).tolist())) == 12 and time.time() - began < 20


def blobs(rng, sizes, dim=12, noise=0.08):
    centres = np.linalg.qr(rng.normal(size=(dim, dim)))[0][: len(sizes)]
    truth = np.repeat(np.arange(len(sizes)), sizes)
    order = rng.permutation(len(truth))
    return (centres[truth] + noise * rng.normal(size=(len(truth), dim)))[order], truth[order]


@pytest.mark.parametrize("sizes", [(20, 20), (30, 12, 25), (15, 40, 10, 22)])
def test_spectral_finds_blobs_and_their_number(sizes):
    x, truth = blobs(np.random.default_rng(len(sizes)), sizes)
    want = clusters.by_appearance(truth).tolist()
    assert clusters.spectral(x, len(sizes)).tolist() == want and clusters.spectral(x).tolist() == want
    assert clusters.spectral(x, len(sizes)).tolist() == clusters.spectral(x, len(sizes)).tolist()  # drawn with a seed


def test_spectral_of_few():
    x = np.eye(3)
    assert clusters.spectral(x, 3).tolist() == clusters.spectral(x, 9).tolist() == [0, 1, 2] and clusters.spectral(x[:2]).tolist() == [0, 1]


def test_clusters_by_key(spark):
    rng = np.random.default_rng(2)
    x, truth = blobs(rng, (6, 7, 8))
    rows = [(k, i, v.tolist()) for k in (1, 2) for i, v in enumerate(x if k == 1 else x[::-1])]
    df = spark.createDataFrame(rows, "key long, seq long, v array<double>").repartition(3)
    for method, how in (("ward", {"count": 3}), ("complete", {"threshold": 0.5}), ("spectral", {"count": 3})):
        got = {(r.key, r.seq): r.cluster for r in clusters.clustered_by(df, method, **how).collect()}
        for k, t in ((1, truth), (2, truth[::-1])):
            assert [got[k, i] for i in range(len(x))] == clusters.by_appearance(t).tolist()


# phrases


def naive_hits(words, phrases):
    return sorted((at + len(p) - 1, k) for k, p in enumerate(phrases) for at in range(len(words) - len(p) + 1) if tuple(words[at : at + len(p)]) == p)


def test_hits_of_overlapping_phrases():
    rng = random.Random(3)
    for _ in range(200):
        phrases = list({tuple(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))})
        words = rng.choices("abcd", k=40)
        assert sorted(terms.Automaton(phrases).hits(words)) == naive_hits(words, phrases)
    assert list(terms.Automaton([]).hits("abc")) == [] and list(terms.Automaton([()]).hits("abc")) == []


def test_rewards_are_paid_back_unless_earned():
    ln2, ln3 = math.log(2), math.log(3)
    a = terms.Automaton([("a", "b", "c"), ("b", "d")], other=0.0)
    one, s = a.reward(0, "a")
    two, s = a.reward(s, "b")
    assert (one, two) == (1.0, 2.0 + ln2)
    three, t = a.reward(s, "c")
    assert three == pytest.approx(2.0 + ln3)
    assert a.reward(t, "x") == (0.0, 0)  # the phrase was completed: nothing is taken back
    # "a b" is left for "b": all but the reward of "b" is paid back, then "d" is paid.
    left, u = a.reward(s, "d")
    assert left == pytest.approx(1.0 - (3.0 + ln2) + 2.0 + ln2) and a.phrase[u] == 1
    gone, v = a.reward(s, "x")
    assert v == 0 and gone == pytest.approx(-(3.0 + ln2))
    assert terms.Automaton([("a",)], other=0.7).reward(0, "z") == (0.7, 0)


def test_shared_prefixes_and_rewards_sum_up():
    """Along any words, what is gained in all is what the completed phrases and the open prefix are worth."""
    a = terms.Automaton([("k",), ("k", "s")], other=0.0)
    total, state = 0.0, 0
    for w in ("k", "z", "k", "s", "z"):
        gain, state = a.reward(state, w)
        total += gain
    assert total == pytest.approx(1.0 + (1.0 + 2.0 + math.log(2))) and state == 0


def test_phrase_hits_by_automaton_and_by_join(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 30))) if i % 7 else None) for i in range(60)] + [(100, "a"), (101, " a\n\tb  a b ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = [("a b",), ("b",), ("a b a",), (" b   a ",), ("",), (None,), ("never here",), ("b",)]
    phrases = spark.createDataFrame(wanted, "phrase string")
    want = []
    for i, t in rows:
        ws = (t or "").split()
        for p in ("a b", "b", "a b a", "b a", "never here"):
            n = len(naive_hits(ws, [tuple(p.split())]))
            want += [(i, p, n)] * (n > 0)
    for most in (100, 2):
        assert sorted(tuple(r) for r in terms.phrase_hits(docs, phrases, "doc_id", most=most).collect()) == sorted(want)
    assert terms.phrase_hits(docs, phrases.limit(0), "doc_id").collect() == []
    got = {r.doc_id: r for r in terms.boosts(docs.where("doc_id >= 100"), ["a b"], "doc_id").collect()}
    assert got[100].boost == 1.0 and got[101].n_words == 4 and got[101].boost == pytest.approx(2 * (3 + math.log(2)))


# signals


@pytest.mark.parametrize("lag", [-7, 0, 3, 11])
def test_lag_equals_the_direct_search(spark, lag):
    rng = np.random.default_rng(1)
    far = rng.normal(size=400)
    near = np.roll(far, lag) + 0.2 * rng.normal(size=400)
    rows = [(1, i, float(n), float(f)) for i, (n, f) in enumerate(zip(near, far))]
    df = spark.createDataFrame(rows, "stream long, place long, near double, far double").repartition(4)
    assert signals.sample_lag(df, 15).head().lag == lag
    direct = records.best_lag(df.select("stream", F.col("place").alias("tick"), "near", "far"), 15).head()
    assert direct.lag == lag


def test_lag_of_a_long_stream_uses_its_loudest_stretch():
    rng = np.random.default_rng(2)
    far = 0.01 * rng.normal(size=1_000_000)
    far[600_000:700_000] *= 100
    near = np.roll(far, 480)
    near[:500_000] = np.roll(far, 5)[:500_000]  # another lag where it is quiet
    began = time.time()
    assert signals.lag_of(near, far, 3200)[0] == 480 and time.time() - began < 5
    assert signals.loudest(far, 64_000, 160) in range(600_000, 636_001)
    assert signals.lag_of(np.zeros(10), np.zeros(10), 3)[0] == -3  # all lags are equal: the least


def test_reference_windows(spark):
    track = spark.createDataFrame([(1, 10 + i, i + 1) for i in range(5)], "stream long, place long, sample int")  # 10..14
    cases = {(10, 5): [1, 2, 3, 4, 5], (12, 2): [3, 4], (13, 3): None, (8, 4): [0, 0, 1, 2], (4, 6): [0] * 6, (2, 3): [0] * 3, (8, 9): None, (15, 1): None, (11, 0): []}
    asks = [(1, k, at, n) for k, (at, n) in enumerate(cases)] + [(2, 99, 0, 4)]
    got = {r.ask: r.samples for r in signals.reference_windows(track, spark.createDataFrame(asks, "stream long, ask long, place long, count long")).collect()}
    assert got == {**dict(enumerate(cases.values())), 99: None}


def test_echo_loss(spark):
    rows = [(1, i, 0.5, 0.05, 0.5 if i < 320 else 0.0) for i in range(640)] + [(2, i, 0.1, 0.1, 0.0) for i in range(160)]
    rows = [(s, i, m if i < 320 else 0.9, o if i < 320 else 0.9, f) for s, i, m, o, f in rows]
    got = signals.echo_loss(spark.createDataFrame(rows, "stream long, place long, mic double, out double, far double")).collect()
    assert [(r.stream, r.active, round(r.loss_db, 6)) for r in got] == [(1, 2, 20.0)]


# galleries and propagation


def test_propagation(spark):
    spans = [(1, "a", 0, 10), (1, "b", 20, 30), (1, "c", 5, 25), (1, "d", 100, 110), (1, "e", 8, 9), (1, "e", 8, 9), (1, "f", 22, 23), (2, "x", 0, 1)]
    vectors = [(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (1, "c", [0.0, 1.0]), (1, "d", [0.2, 0.9]), (1, "e", [0.0, 1.0]), (1, "f", [1.0, 0.0]), (2, "x", [1.0, 0.0]), (1, "g", [0.5, 0.5])]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = updates.propagated(make(spans, "key long, unit string, start long, end long"), make([(1, "a", 0), (1, "b", 1)], "key long, unit string, cluster int"), make(vectors, "key long, unit string, v array<double>"))
    # c shares as much time with both seeds, so the least cluster; d and g (without spans) go by their vectors; key 2 has no seeds.
    assert {(r.key, r.unit): r.cluster for r in got.collect()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 0, (1, "d"): 1, (1, "e"): 0, (1, "f"): 1, (1, "g"): 0, (2, "x"): None}


def plain_replay(clusters_, gallery, rule, threshold):
    out = []
    for group in sorted({c[0] for c in clusters_}):
        known = {}
        for g, name, v in gallery:
            if g == group:
                known.setdefault(name, []).append(np.array(v))
        for meeting in sorted({c[1] for c in clusters_ if c[0] == group}):
            waiting = []
            for _, _, seq, v, clean, true in sorted(c for c in clusters_ if c[:2] == (group, meeting)):
                if not known:
                    continue
                ranked = sorted((-round(float(np.mean([np.array(v) @ e for e in es])), 9), n) for n, es in known.items())
                score, name = -ranked[0][0], ranked[0][1]
                if score < threshold:
                    continue
                add = rule.margin is not None and score >= threshold + rule.margin and clean >= rule.least_clean and (name == true or not rule.sure)
                out.append((group, rule.name, meeting, seq, name, name == true, add))
                if add:
                    waiting.append((name, np.array(v)))
            for name, v in waiting:
                known[name].append(v)
    return out


def test_replayed_policies(spark):
    rng = np.random.default_rng(6)
    people = unit(rng, 5, 6)
    heard, gallery = [], []
    for k in range(120):
        p = int(rng.integers(5))
        v = people[p] + 0.35 * rng.normal(size=6)
        heard.append((k % 2, k // 20, k, (v / np.linalg.norm(v)).tolist(), float(k % 9), f"p{p}"))
    gallery = [(g, f"p{p}", people[p].tolist()) for g in (0, 1) for p in range(4)]  # the fifth is a stranger
    rules = [updates.Policy("never"), updates.Policy("always", 0.0), updates.Policy("margin", 0.15), updates.Policy("clean", 0.0, 5.0), updates.Policy("sure", 0.0, 0.0, True)]
    extra = heard + [(7, 0, 999, people[0].tolist(), 9.0, "p0")]  # a group without a gallery names nobody
    steps = updates.replayed(
        spark.createDataFrame(extra, "group long, meeting long, seq long, v array<double>, clean double, true_name string").repartition(4),
        spark.createDataFrame(gallery, "group long, name string, v array<double>"), rules, 0.5,
    )
    got = sorted((r.group, r.policy, r.meeting, r.seq, r.name, r.correct, r.appended) for r in steps.collect())
    want = sorted(x for rule in rules for x in plain_replay(heard, gallery, rule, 0.5))
    assert got == want
    by = {r.policy: r for r in updates.policy_summary(steps).collect()}
    assert by["never"].added_right == by["never"].added_wrong == by["sure"].added_wrong == 0 < by["always"].added_wrong and by["always"].left_right == 0


def test_fold_steps(spark):
    v = {"a": [1.0, 0.0, 0.0], "b": [0.95, 0.3, 0.0], "c": [0.0, 0.0, 1.0], "d": [0.0, 0.5, 0.9]}
    rows = [(1, k, x, {"a": 1.0, "b": 3.0}.get(k, 2.0), {"a": "P", "b": "Q"}.get(k, "R")) for k, x in v.items()] + [(2, "z", [1.0, 0.0, 0.0], 1.0, "P")]
    steps = updates.fold_steps(spark.createDataFrame(rows, "key long, label string, v array<double>, seconds double, true_name string"), 0.5).orderBy("step").collect()
    assert [(r.key, r.step, r.a, r.b, r.same) for r in steps] == [(1, 0, "a", "b", False), (1, 1, "c", "d", True)]


# annotation files


def test_annotated_words_from_files(spark, tmp_path):
    (tmp_path / "words").mkdir()
    (tmp_path / "words" / "ES01a.A.words.xml").write_text(
        '<?xml version="1.0"?><nite:root xmlns:nite="http://nite.sourceforge.net/"><w nite:id="w0" starttime="0.5" endtime="0.9">Hello</w><w starttime="0.9" endtime="0.9" punc="true">,</w>'
        '<vocalsound starttime="1.0" endtime="2.0" type="laugh"/><w endtime="2.5">lost</w><w starttime="3.0" endtime="3.0">none</w><w starttime="3.5" endtime="3.2">back</w><w starttime="4" endtime="4.25">you &amp; me</w></nite:root>'
    )
    (tmp_path / "words" / "ES01a.B.words.xml").write_text("<root><w starttime='1' endtime='2'>B</w></root>")
    got = annotations.annotated_words(spark, str(tmp_path / "words")).orderBy("agent", "start").collect()
    assert [(r.meeting, r.agent, r.start, r.end, r.text) for r in got] == [("ES01a", "A", 0.5, 0.9, "Hello"), ("ES01a", "A", 4.0, 4.25, "you & me"), ("ES01a", "B", 1.0, 2.0, "B")]


def test_words_round_trip(spark, tmp_path):
    rows = [("m1", "A", "1", 0.1, 0.35, False, "a < b"), ("m1", "B", "2", None, 1.0, False, "x"), ("m2", "A", "3", 1.0, 1.5, True, "."), ("m2", "A", "4", 1 / 3, 2 / 3, None, "ünï")]
    annotations.write_words(spark.createDataFrame(rows, "meeting string, agent string, id string, start double, end double, punc boolean, text string"), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in annotations.annotated_words(spark, str(tmp_path / "out")).collect())
    assert got == [("m1", "A", "1", 0.1, 0.35, "a < b"), ("m2", "A", "4", 1 / 3, 2 / 3, "ünï")]


def test_meetings_and_transcripts_from_files(spark, tmp_path):
    (tmp_path / "meetings.xml").write_text(
        '<meetings><meeting observation="ES01a"><speaker nxt_agent="B" channel="0" global_name="FEE1"/><speaker nxt_agent="A" channel="3" global_name="MEO2"/><speaker nxt_agent="C" global_name="no channel"/></meeting>'
        '<meeting name="without observation"><speaker nxt_agent="A" channel="1" global_name="X"/></meeting></meetings>'
    )
    got = sorted(tuple(r) for r in annotations.meeting_speakers(spark, str(tmp_path / "meetings.xml")).collect())
    assert got == [("ES01a", "A", 3, "MEO2"), ("ES01a", "B", 0, "FEE1")]
    (tmp_path / "mrt").mkdir()
    (tmp_path / "mrt" / "Bmr01.mrt").write_text(
        '<Meeting><Preamble><Channels><Channel Name="chan0" AudioFile="chan0.sph"/><Channel Name="chan1"/></Channels><Participants><Participant Name="me011" Channel="chan0"/><Participant Name="fe2" Channel="chan1"/>'
        '<Participant Name="far"/></Participants></Preamble><Transcript><Segment StartTime="1.5" EndTime="2.5" Participant="me011">hi</Segment><Segment StartTime="3" EndTime="3" Participant="me011"/>'
        '<Segment StartTime="3" EndTime="4" Participant="fe2"/><Segment StartTime="5" EndTime="6"/></Transcript></Meeting>'
    )
    got = [tuple(r) for r in annotations.transcript_segments(spark, str(tmp_path / "mrt")).collect()]
    assert got == [("Bmr01", "me011", "chan0", "chan0.sph", 1.5, 2.5)]


def test_json_beside_transcripts(spark, tmp_path):
    prints = [("m1", "x", "S0", [0.1, 1e-9]), ("m1", "x", "S1", [1.0, -1.0]), ("m2", "y", "S0", [0.5, 0.25])]
    annotations.write_voiceprints(spark.createDataFrame(prints, "meeting string, model string, label string, vector array<double>"), str(tmp_path / "p"))
    assert sorted((r.meeting, r.model, r.label, list(r.vector)) for r in annotations.voiceprints(spark, str(tmp_path / "p")).collect()) == [(*p[:3], p[3]) for p in prints]
    trials = [("t1", "ada", "ada", 0.75), ("t1", "ada", "bob", -0.5), ("t2", None, "ada", 0.125)]
    annotations.write_trials(spark.createDataFrame(trials, "name string, true_speaker string, profile string, score double"), str(tmp_path / "t"))
    assert sorted((tuple(r) for r in annotations.trials(spark, str(tmp_path / "t")).collect()), key=str) == sorted(trials, key=str)
