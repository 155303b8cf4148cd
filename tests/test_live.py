"""Live state: timers, runs sent once, bounded buffers, windows decoded once. Files are the micro-batches."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from parlance.operators import windows
from parlance.streaming import live

S = 1_000_000
WORD = "channel long, seq long, side string, text string, start_us long, end_us long"
RECORD = "channel long, seq long, speech boolean, start_us long, end_us long, value double"


class Feed:
    """A folder whose files are micro-batches."""

    def __init__(self, spark, folder, ddl):
        self.spark, self.folder, self.ddl, self.n = spark, str(folder), ddl, 0
        spark.createDataFrame([], ddl).write.parquet(f"{self.folder}/in", mode="overwrite")

    def add(self, rows):
        self.n += 1
        made = f"{self.folder}/made-{self.n}"
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.parquet(made)
        self.spark.read.parquet(made).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        time.sleep(0.01)

    def stream(self):
        return self.spark.readStream.schema(self.ddl).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")


@pytest.fixture
def feed(spark, tmp_path):
    return lambda ddl: Feed(spark, tmp_path / uuid.uuid4().hex, ddl)


def lines(rows):
    return sorted((r.channel, r.line, r.side, r.text) for r in rows)


def word(channel, seq, side, text, start, end=None):
    return channel, seq, side, text, int(start * S), int((start + 0.3 if end is None else end) * S)


def captions(spark, feed, batches, **how):
    f = feed(WORD)
    for b in batches:
        f.add(b)
    out = f"{f.folder}/out"
    live.decode_once(live.live_captions(f.stream(), idle_ms=None, **how), out).awaitTermination()
    return live.committed(spark, out, live.CAPTIONS).collect(), live.open_rows(spark, f"{out}-state", live.CAPTIONS, "line").collect()


def test_captions_end_at_pauses_switches_and_length(spark, feed):
    batches = [
        [word(1, 1, "mic", "one", 0), word(1, 2, "mic", "two", 0.5)],
        [word(1, 3, "mic", "three", 2.3), word(1, 4, "system", "other", 2.5)],  # exactly 1.5 s after the last end: still the line
        [word(1, 5, "system", "late", 4.31), word(2, 6, "mic", "x" * 12, 0), word(2, 7, "mic", "y" * 8, 0.4), word(2, 8, "mic", "z", 0.8)],
    ]
    sent, held = captions(spark, feed, batches, most_chars=20)
    assert lines(sent) == [(1, 0, "mic", "one two three"), (1, 1, "system", "other"), (2, 0, "mic", "x" * 12 + " " + "y" * 8)]
    assert lines(held) == [(1, 2, "system", "late"), (2, 1, "mic", "z")]


def test_a_timer_ends_a_line_without_another_word(spark, feed):
    f = feed(WORD)
    f.add([word(1, 1, "mic", "left", 0), word(1, 2, "mic", "alone", 0.5)])
    out = f"{f.folder}/out"
    query = live.decode_once(live.live_captions(f.stream(), idle_ms=2500), out, processingTime="300 milliseconds")
    try:
        began = time.time()
        while time.time() - began < 60 and not lines(live.committed(spark, out, live.CAPTIONS).collect()):
            time.sleep(0.3)
        assert lines(live.committed(spark, out, live.CAPTIONS).collect()) == [(1, 0, "mic", "left alone")]
        f.add([word(1, 3, "mic", "again", 0.9)])  # within the pause, but the line is gone
        while time.time() - began < 120 and len(live.committed(spark, out, live.CAPTIONS).collect()) < 2:
            time.sleep(0.3)
        assert lines(live.committed(spark, out, live.CAPTIONS).collect()) == [(1, 0, "mic", "left alone"), (1, 1, "mic", "again")]
    finally:
        query.stop()


def test_runs_are_sent_once_and_equal_the_batch(spark, feed):
    rng = random.Random(1)
    rows, seq = [], 0
    for channel in (1, 2, 3):
        t = 0.0
        for _ in range(60):
            seq += 1
            rows.append(word(channel, seq, "mic", f"w{seq}", t))
            t += rng.choice([0.3, 0.5, 1.8, 1.81, 4.0])
    rows.sort(key=lambda r: (r[4], r[1]))
    f = feed(WORD)
    for at in range(0, len(rows), 37):
        f.add(rows[at : at + 37])
    out = f"{f.folder}/out"
    live.decode_once(live.closed_runs(f.stream()), out).awaitTermination()
    sent = live.committed(spark, out, live.RUNS).collect()
    tail = live.open_rows(spark, f"{out}-state", live.RUNS, "run").collect()
    want = []
    for channel in (1, 2, 3):
        run, last = 0, None
        for r in (r for r in rows if r[0] == channel):
            if last is None or r[4] - last > 1_500_000:
                run += 1
                want.append([channel, run, r[4], r[5], 0, []])
            want[-1][3], want[-1][4], last = r[5], want[-1][4] + 1, r[5]
            want[-1][5].append(r[3])
    assert sorted(tuple(r) for r in sent + tail) == sorted((*w[:5], " ".join(w[5])) for w in want)
    assert len(tail) == 3 and len({(r.channel, r.run) for r in sent}) == len(sent)


def recorded(seed, n=400):
    """Frames each half second, with speech segments among them."""
    rng = random.Random(seed)
    rows, t, seq = [], 0.0, 0
    for _ in range(n):
        seq += 2
        rows.append((1, seq, False, int(t * S), int((t + 0.5) * S), float(rng.randint(1, 9))))
        if rng.random() < 0.3:
            rows.append((1, seq + 1, True, int((t + 0.1) * S), int((t + 0.1 + rng.choice([0.3, 1, 4, 70 if rng.random() < 0.05 else 2])) * S), 0.0))
        t += rng.choice([0.5, 0.5, 0.5, 9.0])
    return sorted(rows, key=lambda r: (r[3], r[1]))


def plain_windows(rows):
    merged = []
    for _, _, speech, s, e, _ in rows:
        if speech and merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        elif speech:
            merged.append([s, e])
    made = []
    for s, e in merged:
        windows.add_segment(made, s, e)
    return made


@pytest.mark.parametrize("size", [17, 1000])
def test_views_are_whole_and_state_is_bounded(spark, feed, size):
    rows = recorded(5)
    f = feed(RECORD)
    for at in range(0, len(rows), size):
        f.add(rows[at : at + size])
    out = f"{f.folder}/out"
    live.decode_once(live.bounded_views(f.stream()), out).awaitTermination()
    sent = sorted(live.committed(spark, out, live.VIEWS).collect(), key=lambda r: r.number)
    want = plain_windows(rows)
    assert len(want) - 2 <= len(sent) < len(want) and [r.number for r in sent] == list(range(len(sent)))
    for r, (start, end) in zip(sent, want):
        seen = [v for _, _, speech, t, _, v in rows if not speech and max(0, start - live.CONTEXT_US) <= t < end]
        assert (r.start_us, r.end_us, r.from_us, r.n, r.total) == (start, end, max(0, start - live.CONTEXT_US), len(seen), sum(seen))
    # A window of 30 s, the context and pad before it, and the pause to the next segment: no more, however long the channel.
    assert max(r.held for r in sent) <= 2 * (30 + 15 + 1 + 30) < sum(not r[2] for r in rows)
    kept = live.still_open(spark, f"{out}-state").selectExpr("length(held) AS n").collect()
    assert max(r.n for r in kept) < 20_000


def test_frames_without_speech_are_trimmed(spark, feed):
    f = feed(RECORD)
    for k in range(4):
        f.add([(1, k * 100 + j, False, (k * 100 + j) * S, (k * 100 + j + 1) * S, 1.0) for j in range(100)])
    out = f"{f.folder}/out"
    live.decode_once(live.bounded_views(f.stream()), out).awaitTermination()
    held = live.still_open(spark, f"{out}-state").selectExpr("size(from_json(held, 'frames array<array<double>>').frames) AS n").collect()
    assert live.committed(spark, out, live.VIEWS).count() == 0 and [r.n for r in held] == [16]


def test_killed_and_resumed_stream_gives_each_window_once(spark, feed):
    rows = recorded(8)
    f = feed(RECORD)
    for at in range(0, len(rows), 60):
        f.add(rows[at : at + 60])
    out, calls = f"{f.folder}/out", []

    def decode(batch):
        calls.append(1)
        if len(calls) in (3, 5):  # dies after a part of the batch was written
            batch.limit(1).write.mode("overwrite").parquet(f"{out}/batch={len(calls) - 1}")
            raise RuntimeError("killed")
        return batch.select("channel", "number", "start_us", "end_us")

    deaths = 0
    for _ in range(10):
        try:
            live.decode_once(live.bounded_views(f.stream()), out, decode).awaitTermination()
            break
        except Exception:
            deaths += 1
            partial = live.committed(spark, out, "channel long, number long, start_us long, end_us long").collect()
            assert len({r.number for r in partial}) == len(partial)
    got = sorted((r.number, r.start_us, r.end_us) for r in live.committed(spark, out, "channel long, number long, start_us long, end_us long").collect())
    want = [(k, *w) for k, w in enumerate(plain_windows(rows))]
    assert deaths == 2 and got == want[: len(got)] and len(got) >= len(want) - 2


def test_live_rows_are_reused_unless_time_was_shed(spark):
    one = spark.createDataFrame([(1, "live"), (2, "live"), (5, "live")], "channel long, text string")
    two = spark.createDataFrame([(c, "again") for c in (1, 2, 3, 5)], "channel long, text string")
    shed = spark.createDataFrame([(1, 0), (2, 900), (5, None)], "channel long, shed_us long")
    assert sorted(tuple(r) for r in live.reused(one, two, shed).collect()) == [(1, "live"), (2, "again"), (3, "again"), (5, "live")]


def test_empty_streams(spark, feed):
    f = feed(WORD)
    out = f"{f.folder}/out"
    live.decode_once(live.closed_runs(f.stream()), out).awaitTermination()
    assert live.committed(spark, out, live.RUNS).count() == 0 and live.open_rows(spark, f"{out}-state", live.RUNS, "run").count() == 0


def test_groups_are_folded_across_batches(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = windows.fold_groups(rows, ["k"], ["v"], lambda rs: [(rs[0][0], len(rs), sum(v for _, v in rs), rs == sorted(rs))], "k long, n long, total long, ordered boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(k, len(range(k, 1000, 3)), sum(range(k, 1000, 3)), True) for k in range(3)]
