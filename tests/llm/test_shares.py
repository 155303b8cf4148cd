"""What tasks hold of texts, and what comparisons of lines cost."""

import numpy as np

from parlance.llm import leaders, lines, pieces
from parlance.llm.common import ARROW_ROWS, NUMBERS, TEXTS, _tidied


def test_a_chunk_that_decodes_to_itself_is_held_once():
    table = pieces.ChunkTable(pieces.model_path())
    text = "plain words  and\n\n tabs\tof \u2581 marks"
    rows = list(table.rows([text]))
    assert rows[0][2] == table.model.decode(table.model.encode(text))
    assert rows[0][0] == ",".join(map(str, table.model.encode(text)))
    held = {k: v for k, v in table.known.items() if k != "\n"}
    assert held and all(k.isascii() and v[2] is k for k, v in held.items())


def test_tokens_sends_few_texts_at_once(spark):
    import corpus_pipeline

    before = spark.conf.get(ARROW_ROWS)
    try:
        docs = spark.createDataFrame([(1, "en", "s", 5, "a b c")], "doc_id long, lang string, source string, n_chars long, text string")
        assert corpus_pipeline.tokens(spark, docs, "").collect()[0].round_trip
        assert int(spark.conf.get(ARROW_ROWS)) == TEXTS
        with _tidied(spark):
            assert int(spark.conf.get(ARROW_ROWS)) == NUMBERS
        assert int(spark.conf.get(ARROW_ROWS)) == TEXTS
    finally:
        spark.conf.set(ARROW_ROWS, before)


def test_links_start_no_python_rows_of_their_own(spark):
    rows = [(k, k, n, 2, 0, bytes([n])) for k, n in ((1, 1), (1, 2), (2, 3), (2, 4))]
    members = spark.createDataFrame(rows, "key long, home long, node long, size long, weight long, data binary")
    links, rest = leaders.leader_links(members, 2, lambda data, node: lambda a, b: np.ones(len(a), dtype=bool), True)
    assert sorted(tuple(sorted(x)) for x in links.collect()) == [(1, 2), (3, 4)] and rest.count() == 0
    assert "ExistingRDD" not in links._jdf.queryExecution().toString()


def test_signatures_of_a_pair_are_met_once(monkeypatch):
    rng, n = np.random.default_rng(3), 40
    bits = rng.integers(0, 1 << 63, (n, lines.SIGNATURE)).astype(np.uint64)
    bits[1::2] = bits[::2] ^ np.uint64(5)
    size, starts = rng.integers(60, 200, n), np.array([0, 10, 11])
    size[1::2] = size[::2]
    brute = np.zeros(n, dtype=bool)
    for at, to in zip(starts, [*starts[1:], n]):
        for a in range(at, to):
            for b in range(at, to):
                lacks = max(sum(int(x & ~y).bit_count() for x, y in zip(bits[i], bits[j])) for i, j in ((a, b), (b, a)))
                longer = max(size[a], size[b])
                brute[a] |= a != b and 100 * (longer - max(lacks, abs(size[a] - size[b]))) >= lines.PERCENT * longer
    count, seen = np.bitwise_count, []
    monkeypatch.setattr(np, "bitwise_count", lambda x: (seen.append(x.size), count(x))[1])
    assert (lines.with_partners(lines.PERCENT, starts, size, bits) == brute).all() and brute.any() and not brute.all()
    pairs = 45 + 29 * 28 // 2
    assert sum(seen) <= lines.SIGNATURE * (pairs + n)
