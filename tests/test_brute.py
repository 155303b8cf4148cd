"""Queries that SQL cannot express, on the smallest tables against plain Python."""

from collections import Counter, defaultdict
from itertools import permutations

import pandas as pd
import pytest
import regex

from parlance import queries

from .test_literal import plain_alignment
from .test_oracle import DATA


def run(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def pairs():
    """(conv, turn, role, words said, words heard): as the queries derive them."""
    out = []
    for c, t, role, text in pd.read_parquet(f"{DATA}/conversations.parquet").astype(object).itertuples(index=False):
        ref = [w for w in regex.sub(r"[^\p{L}\p{N}\p{M}_]+", " ", (text or "").lower()).split(" ") if w]
        kept = [w for w in ref if len(w) % 5]
        out.append((c, t, role, ref, [w + "x" if i % 9 == 8 else w for i, w in enumerate(kept)]))
    return out


def counts(ref, hyp):
    n = Counter(s for s, _, _ in plain_alignment(ref, hyp))
    return n["m"], n["s"], n["i"], n["d"]


def rate(ref, hyp):
    _, s, i, d = counts(ref, hyp)
    return (s + i + d) / len(ref) if ref else None


def test_word_errors(spark, pairs):
    got = {(r.conv_id, r.turn): (r.matches, r.substitutions, r.insertions, r.deletions, r.wer) for r in run(spark, "ag11_word_errors")}
    assert got == {(c, t): (*counts(ref, hyp), None if not ref else round(rate(ref, hyp), 6)) for c, t, _, ref, hyp in pairs}


def test_biased_errors(spark, pairs):
    total = Counter()
    rare = Counter()
    for _, _, _, ref, hyp in pairs:
        listed = {w for w in ref if len(w) > 8}
        given = listed | {w for w in hyp if w.endswith("x")}
        for step, i, j in plain_alignment(ref, hyp):
            word = hyp[j] if step == "i" else ref[i]
            side = "b" if word in listed else "u"
            total[f"{side}_ref"] += step != "i"
            total[f"{side}_errors"] += step != "m"
            rare["words"] += step != "i"
            rare["errors"] += step != "m"
            if step != "i" and word in listed:
                rare["rare_words"] += 1
                rare["found"] += step == "m"
                rare["found_loosely"] += step == "m" or (step == "s" and word in hyp[j])
            rare["rare_errors"] += step != "m" and word in listed
            rare["false_insertions"] += step in "is" and hyp[j] in given
    assert run(spark, "ag10_biased_errors")[0].asDict() == {k: total[k] for k in ("b_ref", "b_errors", "u_ref", "u_errors")}
    got = run(spark, "ag10_biased_rates")[0].asDict()
    assert {k: got[k] for k in rare} == dict(rare) and got["found"] > 0 < got["false_insertions"]
    p, r = rare["found"] / (rare["found"] + rare["false_insertions"]), rare["found"] / rare["rare_words"]
    want = {"wer": rare["errors"] / rare["words"], "b_wer": rare["rare_errors"] / rare["rare_words"], "recall": r, "precision": p, "f1": 2 * p * r / (p + r), "recall_loose": rare["found_loosely"] / rare["rare_words"],
            "u_wer": (rare["errors"] - rare["rare_errors"]) / (rare["words"] - rare["rare_words"])}
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_verdicts_and_tally(spark, pairs):
    want, tally = {}, defaultdict(Counter)
    for c, t, role, ref, hyp in pairs:
        a, b = rate(ref, hyp), rate(ref, [w for i, w in enumerate(ref) if i % 4 != 3])
        verdict = "no-ref" if a is None else "A" if a < b else "B" if b < a else "tie"
        want[c, t] = (verdict, a is not None and a > 0.6)
        tally[role][verdict] += 1
    assert {(r.conv_id, r.turn): (r.verdict, r.dropped) for r in run(spark, "ev06_verdicts")} == want
    assert {r.role: (r.A, r.B, r.tie, r["no-ref"]) for r in run(spark, "ev08_tally")} == {role: tuple(n[v] for v in ("A", "B", "tie", "no-ref")) for role, n in tally.items()}


def test_time_deltas(spark, pairs):
    apart = sorted(abs(i - j) for _, _, _, ref, hyp in pairs for s, i, j in plain_alignment(ref, hyp) if s == "m")
    at = lambda q: apart[max(0, -(-int(q * 1000) * len(apart) // 1000) - 1)]
    assert tuple(run(spark, "ev05_time_deltas")[0]) == (at(0.5), at(0.9), len(apart))


def test_masks_and_cuts_of_vectors(spark):
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in pd.read_parquet(f"{DATA}/embeddings.parquet").itertuples(index=False)}
    on = {r.vec_id: r.n_on for r in run(spark, "wn20_hysteresis")}
    cuts = {r.vec_id: r.cuts for r in run(spark, "wn21_quiet_cuts")}
    for i, v in rows.items():
        high = sorted(v)[int(0.9 * (len(v) - 1))]
        kept = {k for k, x in enumerate(v) if x >= high}
        while True:
            more = {k for k, x in enumerate(v) if x >= 0 and (k - 1 in kept or k + 1 in kept)} - kept
            if not more:
                break
            kept |= more
        assert on[i] == len(kept)
        at, want = 0, []
        while at + 16 < len(v):
            near = range(max(at + 1, at + 13), min(len(v) - 1, at + 19) + 1)
            at = min(near, key=lambda k: (abs(v[k]), k))
            want.append(at)
        assert cuts[i] == ",".join(map(str, want))


def test_diarization_errors(spark):
    """On a grid of 10 ms frames, under every naming."""
    events = pd.read_parquet(f"{DATA}/events.parquet")
    start = (events["ts"].astype("datetime64[us]").astype("int64") - 1704067200000000) // 36000
    length = (events["value"].fillna(0.0).clip(0.1, 30.0) * 100000).apply(lambda x: int(x // 1))
    turns = defaultdict(list)
    for seq, user, kind, s, n in zip(events["event_id"], events["user_id"], events["event_type"], start, length):
        if seq % 2 == 0:
            turns[user].append((seq, kind, int(s), int(s + n)))
    frame = lambda us: max(0, round(us / 10000.0))
    got = {r.channel: (r.ref_frames, r.missed, r.false_alarm, r.confusion) for r in run(spark, "ag12_diarization_errors")}
    for user in sorted(turns)[:6]:
        ref, hyp, hidden = defaultdict(set), defaultdict(set), set()
        for seq, kind, s, e in turns[user]:
            for f in range(frame(s), frame(e)):
                ref[f].add(kind)
            for b in {round(s / 10000.0), round(e / 10000.0)}:
                hidden |= set(range(b - 25, b + 25))
            if seq % 20:
                for f in range(frame(s + 50000), frame(e + 50000)):
                    hyp[f].add("other" if seq % 14 == 0 else f"h_{kind}")
        frames = (set(ref) | set(hyp)) - hidden
        n_ref = sum(len(ref[f]) for f in frames)
        missed = sum(max(0, len(ref[f]) - len(hyp[f])) for f in frames)
        false = sum(max(0, len(hyp[f]) - len(ref[f])) for f in frames)
        cells = Counter((r, h) for f in frames for r in ref[f] for h in hyp[f])
        rs, hs = sorted({r for r, _ in cells}), sorted({h for _, h in cells})
        wide = rs + [None] * len(hs)
        best = max((sum(cells.get((r, h), 0) for r, h in zip(p, hs)) for p in permutations(wide, len(hs))), default=0)
        assert got[user] == (n_ref, missed, false, sum(min(len(ref[f]), len(hyp[f])) for f in frames) - best)
