"""Line deduplication in large buckets against all pairs of lines that share a block."""

import random

import pytest

from parlance.llm import leaders, lines


def blocks_of(line):
    return set(lines.unpacked(lines.line_table([line]).column("blocks"))[0].tolist())


def drifting(rng, chains, steps):
    """Lines of 40 words of which 31 long ones stand in all and make up all blocks. A line lacks three more words of its chain's first than the one before it, until all nine are new."""
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    long = [word(12) for _ in range(31)]
    shared = blocks_of(" ".join(long))
    out = []
    for _ in range(chains):
        now = None
        for step in range(steps):
            while True:
                new = [word(3) if now is None or p // 3 == step % 3 else now[p] for p in range(9)]
                if blocks_of(" ".join(long + new)) == shared:
                    break
            now = new
            out.append(" ".join(long + now))
    rng.shuffle(out)
    return out


def kept_by_all_pairs(texts):
    """The first line of each group, where all similar pairs that share a block are links."""
    blocks = [blocks_of(t) for t in texts]
    words, root = [t.split() for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if blocks[i] & blocks[j] and lines.similar(words[i], words[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {texts[i] for i in range(len(texts)) if find(i) == i}


@pytest.mark.parametrize("group", [4096, 20])
def test_no_similar_pair_of_a_large_bucket_is_lost(spark, monkeypatch, group):
    monkeypatch.setattr(leaders, "GROUP", group)
    texts = drifting(random.Random(5), 20, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.text for r in lines.deduplicate_lines(docs).where("text <> ''").collect()} == kept_by_all_pairs(texts)


def test_words_go_only_to_buckets_with_possible_partners(spark):
    """Unlike lines that share a block by chance stay out of it; all others stay in, and the size follows."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    first = [[word() for _ in range(12)] for _ in range(40)]
    texts = [" ".join(w) for w in first] + [" ".join([*w[:11], word()]) for w in first[:15]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = lines._line_rows(docs).where("own")
    node = {r.doc_id: r.h1 for r in own.collect()}
    members = [(k, d) for k in range(60) for d in rng.sample(range(len(texts)), 2 + k % 9)] + [(100 + k, d) for k in range(15) for d in (k, 40 + k)]
    sizes = {k: sum(x == k for x, _ in members) for k, _ in members}
    shared = spark.createDataFrame([(k, k, node[d], sizes[k]) for k, d in members], "key long, home long, node long, size long")
    words = [t.split() for t in texts]
    expected = {(k, node[d]) for k, d in members if any(x == k and e != d and lines.similar(words[d], words[e]) for x, e in members)}
    found = {(r.key, r.node): r.size for r in lines.promising(own, shared, 4).collect()}
    assert expected <= found.keys() and len(found) < len(members) / 2
    assert found == {(k, n): sum(x == k for x, _ in found) for k, n in found}
