"""Record and note operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from parlance.operators import notes, records, voices
from parlance.sources import transcripts

WORDS = "array<struct<text: string, start: double, end: double>>"


def test_shift_and_clip(spark):
    df = spark.createDataFrame([("a b", 0.0, 2.0, [("a", 0.0, 0.9), ("b", 1.0, 2.0)]), ("c", 0.0, 0.5, [("c", 0.0, 0.5)]), ("d", 3.0, 4.0, [("d", 3.0, 4.0)])], f"text string, start double, end double, words {WORDS}")
    got = {r.text: (r.start, r.end) for r in records.clipped(df, F.lit(1.0)).collect()}
    assert got == {"b": (1.0, 2.0), "d": (3.0, 4.0)}
    moved = records.shifted(df, F.lit(10.0)).collect()[0]
    assert (moved.start, moved.end, moved.words[1].start) == (10.0, 12.0, 11.0)


def test_samples(spark):
    row = spark.createDataFrame([([0.5, -1.0, 1.0, 1.5 / 32768, 2.5 / 32768],)], "s array<double>").select(records.to_int16(F.col("s")).alias("s")).head()
    assert row.s == [16384, -32768, 32767, 2, 2]
    assert spark.range(1).select(records.sample_index(F.lit(1.99999)).alias("i")).head().i == 31999
    frames = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, -6), (1, 1, 0, 30000), (1, 1, 1, 30000)], "stream long, frame long, channel long, sample long")
    assert {r.frame: r.sample for r in records.downmix(frames).collect()} == {0: -1, 1: 30000}
    mixed = {r.place: r.sample for r in records.mix(frames.withColumnRenamed("frame", "place")).collect()}
    assert mixed[1] == 32767 and mixed[0] == -1


def test_tokens_and_sentences(spark):
    rows = [(1, i, t, i * 10, i * 10 + 5, c) for i, (t, c) in enumerate([(" he", 0.9), ("llo", 0.5), (" ", None), ("you.", 0.8), (" Go", None)])]
    got = records.merged_tokens(spark.createDataFrame(rows, "key long, seq long, text string, start_us long, end_us long, confidence double")).orderBy("start_us").collect()
    assert [(r.text, r.confidence) for r in got] == [("hello", 0.5), ("you.", 0.8), ("Go", None)]
    words = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Yes.", "I", "do!", "Well"])], "key long, seq long, text string")
    assert [r.text for r in records.sentences(words).orderBy("sentence").collect()] == ["Yes.", "I do!", "Well"]


def test_store(spark):
    old = spark.createDataFrame([("A", "m", i, 1.0, f"2024-01-{i:02d}" if i else None) for i in range(8)], "name string, model string, idx long, vector double, date string")
    new = spark.createDataFrame([("A", "m", 0, 2.0, "2024-02-01"), ("B", "m", 0, 3.0, None)], old.schema)
    got = records.upserted(old, new)
    a = got.where("name = 'A'").orderBy("idx").collect()
    assert len(a) == 8 and all(r.date for r in a) and a[-1].vector == 2.0 and got.where("name = 'B'").count() == 1
    assert records.renamed(got, "B", "A").where("name = 'B'").count() == 0


def test_notes(spark):
    text = "intro\n# One\n- a\n```\n# not a heading\n```\n## Two\n\ntext"
    docs = spark.createDataFrame([(1, text), (2, "")], "k long, t string")
    assert [(r.level, r.title) for r in notes.headings(docs, "k", "t").orderBy("line").collect()] == [(1, "One"), (2, "Two")]
    assert {r.section: r.n_lines for r in notes.sections(docs, "k", "t").where("k = 1").collect()} == {0: 1, 1: 4, 2: 1}
    assert {r.k: r.warnings for r in notes.missing_sections(docs, "k", "t", ["one", "Three"]).collect()} == {1: ["Three"], 2: ["one", "Three"]}
    made = spark.range(1).select(notes.prompt(F.lit(None).cast("string"), F.lit("en"), F.array(F.lit("A"), F.lit("B")), F.lit("body")).alias("p")).head().p
    assert made == "Language: en\nAttendees: A, B\nTranscript:\nbody"


def test_clusters_and_scores(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.99, 0.14]), (1, 2, [0.0, 1.0])]
    got = {r.seq: r.cluster for r in records.clustered(spark.createDataFrame(rows, "key long, seq long, v array<double>"), 0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 1}
    assert records.hysteresis([0.1, 0.5, 0.9, 0.5, 0.1, 0.5], 0.8, 0.4) == [False, True, True, True, False, False]
    scored = spark.createDataFrame([(1, 7, 0.6), (1, 3, 0.6), (2, 1, 0.5)], "trial long, profile long, score double")
    assert {r.trial: r.profile for r in voices.best_match(scored).collect()} == {1: 3, 2: None}


def test_profiles_of_both_versions(spark):
    df = spark.createDataFrame([("A", "m", [1.0], None), ("B", "m", None, [([2.0], "2024-01-01")])], "name string, embedding_model string, embedding array<double>, embeddings array<struct<vector: array<double>, date: string>>")
    got = {r.name: r.embeddings for r in transcripts.upgraded_profiles(df).collect()}
    assert got["A"][0].vector == [1.0] and got["A"][0].date is None and got["B"][0].date == "2024-01-01"


@pytest.mark.parametrize(("names", "want"), [(["x", "x", "y"], ["x", "x-2", "y"])])
def test_free_names(spark, names, want):
    df = spark.createDataFrame(list(enumerate(names)), "seq long, base string")
    assert [r.name for r in transcripts.free_names(df, "base").orderBy("seq").collect()] == want


def test_cuts_and_unwrapping():
    assert records.quiet_cuts([5, 5, 5, 1, 5, 5, 5, 0, 5], 4, 1) == [3, 7] and records.quiet_cuts([1, 2], 4, 1) == []
    assert notes.unwrapped("```md\n# T\n\nbody\n```") == ("T", "body")
    assert notes.unwrapped("a\n```\ncode\n```") == (None, "a\n```\ncode\n```")
    assert notes.unwrapped("") == (None, "")


@pytest.mark.parametrize(("response", "want"), [
    ("Here are your notes!\n# Title\nbody", ("Title", "body")), ("Sure:\n```\n# T ##\n\nbody\n```\nBye", ("T", "body")), ("<think>\n# no\n</think>\n# T\nb", ("T", "b")),
    ("b\n<think># no", (None, "b")), ("# T\nb\n```", ("T", "b")), ("# T\n```\ncode\n```", ("T", "```\ncode\n```")), ("~~~\n# T\nb", ("T", "b")), ("```\n# in\n```\n# T\nb", ("T", "b")), ("## only\ntext", (None, "## only\ntext")),
])
def test_notes_in_responses(response, want):
    assert notes.unwrapped(response) == want


def _turn(seq, who, start, words, step=0.6, length=0.5):
    ws = [(int((start + step * k) * 1e6), int((start + step * k + length) * 1e6), w) for k, w in enumerate(words)]
    return (1, seq, who, " ".join(words), ws[0][0], ws[-1][1], ws)


def test_subtitles(spark):
    """A long turn is cut into cues, one without words is one cue, cues of all speakers are in order, and characters are escaped before lines are wrapped."""
    rows = [_turn(1, "Local-1", 0.0, [f"wort{k:02d}" for k in range(20)]), _turn(2, "Remote-1", 3.0, ["ja", "genau"]), (1, 3, "Local-2", "a < b & c " + "x" * 31, 3_661_000_000, 3_662_500_000, None)]
    df = spark.createDataFrame(rows, "meeting long, seq long, speaker string, text string, start_us long, end_us long, ws array<struct<start_us: long, end_us: long, text: string>>")
    blocks = [b.splitlines() for b in transcripts.srt(df).head().text.strip().split("\n\n")]
    assert [b[0] for b in blocks] == [str(k + 1) for k in range(len(blocks))] and len(blocks) == 4
    assert blocks[0][1] == "00:00:00,000 --> 00:00:05,900" and blocks[0][2].startswith("Local-1: ")
    assert all(len(line) <= 42 for b in blocks for line in b[2:])
    assert [b[1][:12] for b in blocks] == sorted(b[1][:12] for b in blocks) and blocks[1][1].startswith("00:00:03,000")
    vtt = transcripts.vtt(df).head().text
    assert vtt.startswith("WEBVTT\n\n") and "01:01:01.000 --> 01:01:02.500\n<v Local-2>a &lt; b &amp; c\n" + "x" * 31 + "</v>" in vtt
    assert len(transcripts.srt(df.drop("ws")).head().text.strip().split("\n\n")) == 3
