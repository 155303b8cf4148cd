"""Operators on literal cases."""

import difflib
import random
from itertools import permutations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import intervals, matching, speech, voices, windows
from parlance.sources import transcripts
from parlance.streaming import speech as streaming

S = 1_000_000


def words(spark, rows):
    made = [(i, 1, t, int(s * S), int(e * S), int((s + e) / 2 * S)) for i, (t, s, e) in enumerate(rows)]
    return spark.createDataFrame(made, "seq long, channel long, text string, start_us long, end_us long, mid_us long")


def turns(spark, rows):
    made = [(i, 1, w, int(s * S), int(e * S)) for i, (w, s, e) in enumerate(rows)]
    return spark.createDataFrame(made, "seq long, channel long, speaker string, start_us long, end_us long")


def entries(spark, ws, ts):
    made = speech.to_entries(speech.sessions(speech.assign(words(spark, ws), turns(spark, ts))))
    return [(r.speaker, r.text, r.provisional) for r in made.orderBy("run").collect()]


@pytest.mark.parametrize(("ws", "ts", "want"), [
    ([("a", 0, 0.4), ("b", 0.5, 0.9)], [("S1", 0, 2)], [("S1", "a b", False)]),
    ([("a", 0, 0.4), ("b", 1.1, 1.5)], [("S1", 0, 1), ("S2", 1, 2)], [("S1", "a", False), ("S2", "b", False)]),
    ([("a", 0, 0.4), ("b", 5, 5.4)], [("S1", 0, 6)], [("S1", "a", False), ("S1", "b", False)]),
    ([("a", 0, 1)], [("S1", 0, 0.6), ("S2", 0.3, 2)], [("S2", "a", True)]),
    ([("a", 3, 3.4)], [("S1", 0, 1), ("S2", 3.9, 5)], [("S2", "a", False)]),
    ([("a", 2, 2.0)], [("S1", 0, 1), ("S2", 3, 5)], [("S1", "a", False)]),
    ([("a", 0, 0.4)], [], [("S0", "a", False)]),
])
def test_speaker_of_words(spark, ws, ts, want):
    assert entries(spark, ws, ts) == want


@pytest.mark.parametrize(("segments", "total", "want"), [
    ([(1, 5), (6, 10), (12, 20)], 60, [(0.85, 20.15)]), ([(0, 20), (25, 45)], 60, [(0, 20.15), (24.85, 45.15)]), ([(0, 70)], 70, [(0, 30.15), (30.15, 60.15), (60.15, 70)]),
    ([(0, 5), (12, 20)], 60, [(0, 5.15), (11.85, 20.15)]), ([(0, 5), (9, 20)], 60, [(0, 20.15)]), ([(0, 29.9)], 30, [(0, 30)]),
])
def test_pack_windows(spark, segments, total, want):
    df = spark.createDataFrame([(1, int(a * S), int(b * S)) for a, b in segments], "channel long, start_us long, end_us long")
    got = windows.pack_windows(df, F.lit(total * S)).orderBy("start_us").collect()
    assert [(r.start_us / S, r.end_us / S) for r in got] == [pytest.approx(w) for w in want]


def test_cues_break_on_length_time_and_pause(spark):
    ws = [("w" * 40, 0, 1), ("w" * 40, 1, 2), ("x" * 10, 2, 3), ("y", 3, 9.5), ("z", 11, 12)]
    made = [(1, "A", [(int(s * S), int(e * S), t) for t, s, e in ws])]
    df = spark.createDataFrame(made, "k long, speaker string, ws array<struct<start_us: long, end_us: long, text: string>>")
    assert [r.text for r in windows.cues(df, ["k"]).orderBy("seq").collect()] == ["w" * 40 + " " + "w" * 40, "x" * 10, "y", "z"]


def test_echo(spark):
    said = "we cannot say sorry for what has happened here"
    rows = [("user", 1, "we can't not say sorry for what has happened here", 10, 12), ("user", 2, "yeah yeah", 10, 12), ("user", 3, said, 60, 62), ("user", 4, "a thing of my own to say now", 10, 12), ("assistant", 5, said, 11, 13)]
    df = spark.createDataFrame([(1, s, who, t, a * S, b * S) for who, s, t, a, b in rows], "meeting long, seq long, speaker string, text string, start_us long, end_us long")
    kept = matching.without_echo(df.where("speaker = 'user'"), df.where("speaker <> 'user'"), T.plain_words(F.col("text")))
    assert sorted(r.seq for r in kept.collect()) == [2, 3, 4]


@pytest.mark.parametrize(("heard", "terms", "threshold", "want"), [
    (["Grafswald,"], ["Greifswald"], 0.8, ["Greifswald,"]), (["Grafswald,"], ["Greifswald"], 0.95, ["Grafswald,"]), (["Danjel"], ["Daniel"], 0.8, ["Daniel"]),
    (["Kubernets"], ["kubernetes"], 0.9, ["Kubernetes"]), (["the", "Mett", "Unie,", "is"], ["Met Uni"], 0.8, ["the", "Met", "Uni,", "is"]), (["metuni"], ["Met Uni"], 0.8, ["metuni"]), (["in", "Grafswald", "bei"], ["greifswald"], 0.8, ["in", "Greifswald", "bei"]), (["abc"], ["abd"], 0.5, ["abc"]),
])
def test_corrections(heard, terms, threshold, want):
    assert matching.corrected(heard, terms, threshold) == want


def test_alignment_prefers_substitution():
    assert [s for s, _, _ in matching.aligned(["call", "ada", "now"], ["call", "adder", "now"])] == ["m", "s", "m"]
    assert matching.aligned([], []) == [] and [s for s, _, _ in matching.aligned(["a"], [])] == ["d"] and [s for s, _, _ in matching.aligned([], ["a"])] == ["i"]


def test_word_errors(spark):
    df = spark.createDataFrame([(["call", "ada", "now"], ["call", "adder", "now"], ["ada"]), ([], ["x"], [])], "ref array<string>, hyp array<string>, b array<string>")
    got = matching.error_counts(df, "ref", "hyp").collect()
    assert (got[0].wer, got[1].wer) == (pytest.approx(1 / 3), None)
    r = matching.biased_counts(df, "ref", "hyp", "b").head()
    assert (r.b_ref, r.b_errors, r.u_ref, r.u_errors) == (1, 1, 2, 1)


@pytest.mark.parametrize(("hyp", "want"), [
    ([("A", 0, 10)], (0, 0, 0)), ([("B", 0, 10)], (0, 0, 0)), ([], (950, 0, 0)), ([("A", 0, 15)], (0, 475, 0)), ([("A", 0, 5), ("B", 5, 10)], (0, 0, 475)), ([("A", 0.1, 10)], (0, 0, 0)),
])
def test_diarization_errors(spark, hyp, want):
    r = matching.diarization_errors(turns(spark, [("A", 0, 10)]), turns(spark, hyp)).head()
    assert (r.missed, r.false_alarm, r.confusion) == pytest.approx(want, abs=26)


@given(st.integers(1, 5), st.integers(1, 9), st.randoms(use_true_random=False))
def test_assignment(rows, cols, rng):
    gain = [[rng.randint(0, 20) for _ in range(cols)] for _ in range(rows)]
    got = matching.assignment(gain)
    used = [j for j in got if j >= 0]
    assert len(used) == len(set(used))
    n = max(rows, cols)
    best = max(sum(gain[i][p[i]] for i in range(rows) if p[i] < cols) for p in permutations(range(n), rows))
    assert sum(gain[i][j] for i, j in enumerate(got) if j >= 0) == best


def test_vote(spark):
    rows = [("und das ist nicht so", "de"), ("this is what they were about", "en"), ("für müssen", "de"), ("the", None), ("", None), ("und ist nicht the and is", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r.v for r in df.select(T.language_vote(F.col("t")).alias("v")).collect()] == [w for _, w in rows]


def test_fold_and_collapse(spark):
    rows = [(1, "S1", 60.0, [1.0, 0.0]), (1, "S2", 50.0, [0.95, 0.312]), (1, "S3", 5.0, [0.0, 1.0]), (2, "S1", 60.0, [1.0, 0.0]), (2, "S2", 5.0, [0.6, 0.8]), (2, "S3", 50.0, [0.0, 1.0]), (3, "S1", 1.0, None), (3, "S2", 2.0, [1.0, 0.0]), (3, "S3", 3.0, None)]
    df = spark.createDataFrame(rows, "channel long, label string, seconds double, v array<double>")
    got = {(r.channel, r.label): r.into for r in voices.fold(df, 2).collect()}
    assert got[1, "S2"] == "S1" and got[1, "S3"] == "S3" and got[2, "S2"] == "S3" and got[3, "S1"] == "S1"
    flags = {r.channel: r.collapse for r in voices.collapse(df).collect()}
    assert flags == {1: False, 2: False, 3: False}
    assert voices.collapse(df.where("channel = 1 and label <> 'S3'")).head().collapse


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).head().x

    assert one(T.subtitle_time(F.lit(3_661_002_500), ",")) == "01:01:01,002" and one(T.subtitle_time(F.lit(-5), ".")) == "00:00:00.000"
    assert one(T.clock(F.lit(61_900_000))) == "1:01" and one(T.clock(F.lit(3_600_000_000))) == "1:00:00"
    assert one(T.escape_vtt(F.lit("a<b>&"))) == "a&lt;b&gt;&amp;"
    assert one(T.slug(F.lit('  a/b:  "c" '))) == "a b c" and one(T.slug(F.lit("//"))) == "Meeting"
    assert one(T.without_reasoning(F.lit("x <think>a\nb</think>y<think>z"))) == "x y"
    assert one(T.wrap(F.lit("aa bbb cccc d"), 6)) == "aa bbb\ncccc d"
    assert one(T.surface_forms(F.lit("term"))) == ["term", "Term"] and one(T.surface_forms(F.lit("iOS"))) == ["iOS"]
    assert one(T.name_forms(F.lit("Ada Byron"))) == ["Ada Byron", "Ada", "Byron"]
    assert str(one(T.meeting_time(F.lit("meeting-20240102-030405")))) == "2024-01-02 03:04:05" and one(T.meeting_time(F.lit("x"))) is None


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"language": "en", "unknown": 1, "entries": [{"speaker": "A", "text": "hi", "start": 0, "end": 1}]}')
    r = transcripts.read_transcripts(spark, str(tmp_path)).head()
    assert r.version == 1 and r.entries[0].text == "hi"
    (tmp_path / "b.json").write_text('{"version": 2, "entries": []}')
    with pytest.raises(Exception, match="newer"):
        transcripts.read_transcripts(spark, str(tmp_path)).collect()
    (tmp_path / "t.txt").write_text("Alpha # note\n\n#x\nBeta\n")
    assert [r.term for r in transcripts.read_terms(spark, f"{tmp_path}/t.txt").collect()] == ["Alpha", "Beta"]
    (tmp_path / "x.rttm").write_text(";; c\n\nSPEAKER f 1 0.5 2.0 <NA> <NA> A <NA> <NA>\nSPEAKER f 1 3 0 <NA> <NA> B\nOTHER\n")
    got = transcripts.read_rttm(spark, f"{tmp_path}/x.rttm")
    assert [(r.start, r.end, r.speaker) for r in got.collect()] == [(0.5, 2.5, "A")]
    transcripts.write_rttm(got, f"{tmp_path}/out")
    assert transcripts.read_rttm(spark, f"{tmp_path}/out").count() == 1
    (tmp_path / "m.json").write_text('[{"id": "a"}, {"id": "a"}]')
    with pytest.raises(Exception, match="repeated id"):
        transcripts.read_manifest(spark, f"{tmp_path}/m.json").collect()
    with pytest.raises(KeyError):
        transcripts.render(spark.range(0), ["pdf"])


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=12), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=8), st.integers(1, 9))
def test_bins_lose_and_repeat_nothing(a, b, width):
    """The rule of the binned overlap join, in plain Python: a pair counts in the bin of the later start."""
    found = []
    for x, n in a:
        for y, m in b:
            low, high = max(x, y), min(x + n, y + m)
            for k in range(x // width, (x + n - 1) // width + 1):
                if y // width <= k <= (y + m - 1) // width and low < high and low // width == k:
                    found.append((x, n, y, m))
    assert sorted(found) == sorted((x, n, y, m) for x, n in a for y, m in b if max(x, y) < min(x + n, y + m))


def test_interval_algebra(spark):
    rng = random.Random(3)
    make = lambda n: [(1, s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(n))]
    spans, cuts = make(8), make(5)
    df = lambda rows: spark.createDataFrame(rows, "k long, start_us long, end_us long")
    left = intervals.subtract(df(spans), df(cuts), ["k"], "start_us", "end_us").collect()
    covered = lambda rows: {t for _, a, b in rows for t in range(a, b)}
    assert {t for r in left for t in range(r.start_us, r.end_us)} == covered(spans) - covered(cuts)
    got = intervals.depth(df(spans), ["k"], "start_us", "end_us").collect()
    assert all(r.depth == sum(a <= t < b for _, a, b in spans) for r in got for t in range(r.start_us, r.end_us))


def test_strict_stream_and_taps(spark, tmp_path):
    ticks = spark.createDataFrame([(1, t, 0 if 5 <= t < 40 else 1, 0 if t % 9 == 0 else 1) for t in range(60)], "channel long, tick long, far int, mic int")
    got = streaming.dead_taps(ticks, 20).collect()
    assert len(got) == 1 and got[0].start == 5 and got[0].end == 39
    kept, lost = streaming.shed(spark.createDataFrame([(1, 0, 5 * S, 6 * S), (1, 5 * S, 9 * S, 60 * S)], "channel long, start_us long, end_us long, now_us long"))
    assert kept.count() == 1 and lost.head().shed_us == 4 * S


def test_ratio_is_difflib():
    assert difflib.SequenceMatcher(None, "abcd", "bcde").ratio() == 0.75 and matching.covered("abc", "abc") == 1.0 and matching.covered("", "x") == 0.0


def plain_alignment(ref, hyp):
    """The whole table, and its cheapest path: diagonal before insertion before deletion."""
    cost = [[3 * (i + j) if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + 4 * (ref[i - 1] != hyp[j - 1]), cost[i][j - 1] + 3, cost[i - 1][j] + 3)
    i, j, steps = len(ref), len(hyp), []
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + 4 * (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            steps.append(("m" if ref[i] == hyp[j] else "s", i, j))
        elif j and cost[i][j] == cost[i][j - 1] + 3:
            j -= 1
            steps.append(("i", i, j))
        else:
            i -= 1
            steps.append(("d", i, j))
    return steps[::-1]


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_alignment_by_rows(ref, hyp):
    assert matching.aligned(ref, hyp) == plain_alignment(ref, hyp)


def test_best_partners(spark):
    rng = random.Random(2)
    cells = [(k, f"r{i}", f"h{j}", rng.randint(0, 9)) for k in range(5) for i in range(k) for j in range(3) if rng.random() < 0.8]
    got = {r.key: (r.total, r.matched) for r in matching.best_partners(spark.createDataFrame(cells, "key long, a string, b string, n long"), "key", "a", "b").collect()}
    for k in {c[0] for c in cells}:
        of = {(a, b): n for key, a, b, n in cells if key == k}
        rows, cols = sorted({a for a, _ in of}), sorted({b for _, b in of})
        wide = rows + [None] * len(cols)
        best = max(sum(of.get((r, c), 0) for r, c in zip(p, cols)) for p in permutations(wide, len(cols)))
        assert got[k] == (sum(of.values()), best)


def test_wrap(spark):
    texts = ["", "a", "word " * 30, "x" * 50, "ab " + "y" * 43 + " cd", "z" * 42 + " e", "a  b\t\nc" + " \u2028 long" * 9, "ünïcödé \U0001f600 " * 8]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.wrap(F.col("t")).alias("w")).orderBy("i").collect()]
    for text, w in zip(texts, got):
        lines, line = [], ""
        for word in [x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", text) if x]:
            if line and len(line) + 1 + len(word) > 42:
                lines, line = [*lines, line], word
            else:
                line = f"{line} {word}" if line else word
        assert w == "\n".join([*lines, line] if line else lines)
