"""Large families of similar lines, end to end: what line deduplication removes against a comparison of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import leaders, lines


def word(rng):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))


def slot_family(rng, n, slots, size, ids):
    """Lines of ``n`` words that differ in some places."""
    base, places = [word(rng) for _ in range(n)], rng.sample(range(n), slots)
    return [" ".join(word(rng) + (str(rng.randint(0, 99999)) if ids else "") if p in places else w for p, w in enumerate(base)) for _ in range(size)]


def template_family(rng, n, changes, size, words=None):
    """A line and variants with some words changed anywhere."""
    base = words or [word(rng) for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        places = rng.sample(range(n), changes)
        out.append(" ".join(word(rng) if p in places else w for p, w in enumerate(base)))
    return out


def families():
    rng = random.Random(7)
    out = {f"slot {n} {size}": slot_family(rng, n, 1, size, ids) for n in (5, 6, 7, 8, 9) for size, ids in ((17, False), (200, True))}
    out |= {f"slots {n}": slot_family(rng, n, 2, 60, n % 2 == 0) for n in (10, 11, 12, 15)}
    out |= {f"template {n}": template_family(rng, n, n // 5, 201) for n in (15, 20, 50)}
    common = [word(rng) for _ in range(30)]  # families that share words, and so blocks
    for k in range(3):
        base = rng.choices(common, k=12) + [word(rng) for _ in range(4)]
        rng.shuffle(base)
        out[f"mixed {k}"] = template_family(rng, 16, 3, 150, base)
    return out


def expected(family):
    root = list(range(len(family)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    split = [x.split() for x in family]
    for i in range(len(family)):
        for j in range(i):
            if find(i) != find(j) and lines.similar(split[i], split[j]):
                root[find(i)] = find(j)
    return len(family) - len({find(i) for i in range(len(family))})


@pytest.fixture(scope="module")
def left(spark):
    rng = random.Random(11)
    every = [x for f in families().values() for x in f]
    alone = [" ".join(word(rng) for _ in range(rng.randint(3, 25))) for _ in range(3000)]
    mixed = every + alone
    rng.shuffle(mixed)
    rows = [(i, "\n".join(mixed[i * 20 : i * 20 + 20])) for i in range(-(-len(mixed) // 20))]
    found = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    kept = {x for r in found for x in r.text.split("\n")}
    assert set(alone) <= kept
    return kept


@pytest.mark.parametrize("name", sorted(families()))
def test_family_goes_but_for_one(left, name):
    family = families()[name]
    want, gone = expected(family), sum(x not in left for x in family)
    assert 0.9 * want <= gone <= want and want > 0


def _members(shared):
    of = {}
    for r in shared.collect():
        of.setdefault((r.key, r.size), []).append(r.node)
    return [(size, nodes) for (_, size), nodes in of.items()]


def test_hot_block_beside_others(spark, monkeypatch):
    """A key that many distinct lines share is counted apart, and gives the same rows."""
    rng = random.Random(3)
    family = slot_family(rng, 6, 1, 400, True)
    rows = [(i, x, 0) for i, x in enumerate(family + [" ".join(word(rng) for _ in range(8)) for _ in range(400)])]
    own = lines._line_rows(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).where("own")
    groups = lambda: sorted({(size, tuple(sorted(nodes))) for size, nodes in _members(lines.shared_blocks(own))})
    plain = groups()
    monkeypatch.setattr(lines, "HOT", 2)
    monkeypatch.setattr(lines, "HOT_PARTS", 2)
    assert groups() == plain and plain[-1][0] == len(plain[-1][1]) == 400


def close(data, nodes):
    """Numbers at most 1 apart."""
    values = np.array([int.from_bytes(x.as_py()) for x in data], dtype=np.int64)
    return lambda a, b: np.abs(values[a] - values[b]) <= 1


def pieces_of(values, linked):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_ties_of_small_buckets_are_exact():
    rng = random.Random(2)
    for _ in range(50):
        buckets = [rng.sample(range(40), rng.randint(1, 15)) for _ in range(4)]
        flat = [v for b in buckets for v in b]
        starts = np.cumsum([0] + [len(b) for b in buckets[:-1]])
        found, led, rest = leaders.ties(len(flat), starts, np.zeros(4, dtype=bool), close(pa.array([v.to_bytes(2) for v in flat]), None))
        assert not len(rest) and set(starts.tolist()) <= set(led.tolist())
        for k, b in enumerate(buckets):
            low, high = starts[k], starts[k] + len(b)
            mine = [(flat[x], flat[y]) for x, y in found.tolist() if low <= x < high]
            assert all(abs(x - y) <= 1 for x, y in mine)
            got, want = pieces_of(b, mine), pieces_of(b, [(x, y) for x in b for y in b if 0 < x - y <= 1])
            assert len(set(got.values())) == len(set(want.values()))


@pytest.mark.parametrize("group", [4096, 8])
def test_leaders_of_split_buckets_meet(spark, monkeypatch, group):
    """Two kinds of members, in one bucket of 300 that is dealt into parts, and a bucket of unlike members."""
    monkeypatch.setattr(leaders, "GROUP", group)
    rows = [(2, 7, i, 300, 0, (1000 * (i % 2)).to_bytes(4)) for i in range(300)] + [(4, 7, 1000 + i, 200, 0, (10 * i).to_bytes(4)) for i in range(200)]
    members = spark.createDataFrame(rows, "key long, home long, node long, size long, weight long, data binary").repartition(5)
    links, rest = leaders.leader_links(members, 4, close, 0)
    links, rest = [tuple(r) for r in links.collect()], {r.node for r in rest.collect()}
    of = pieces_of(range(300), links)
    assert len(set(of.values())) == 2 and all((of[i] == of[0]) == (i % 2 == 0) for i in range(300))
    assert group == 8 or rest == set(range(1000 + leaders.LEADERS, 1200))  # all unlike: what the leaders did not settle
    assert rest <= set(range(1000, 1200))
    assert leaders.leader_links(members, 4, close, True)[1].count() == 0  # patience leaves nothing
    nothing = leaders.leader_links(members.limit(0), 4, close, True)
    assert nothing[0].count() == nothing[1].count() == 0


def test_pairs_by_signature_equal_the_plain_rule():
    rng = random.Random(8)
    for _ in range(30):
        base = [rng.choices(range(1 << 32), k=rng.randint(0, 40)) for _ in range(4)]
        rows = []
        for words in base:
            for _ in range(6):
                x = list(words)
                for _ in range(rng.randint(0, 6)):
                    change = rng.randrange(3)
                    if change == 0 and x:
                        x[rng.randrange(len(x))] = rng.randrange(1 << 32)
                    elif change == 1:
                        x.insert(rng.randint(0, len(x)), rng.choice(words or [5]))
                    elif x:
                        x.pop(rng.randrange(len(x)))
                rows.append(x)
        packed = pa.array([np.array(x, dtype=np.uint32).tobytes() for x in rows], pa.binary())
        a, b = (v.ravel() for v in np.meshgrid(np.arange(len(rows)), np.arange(len(rows))))
        got = lines.WordRows(packed.slice(0), np.arange(len(rows))).alike(a, b)
        assert got.tolist() == [bool(rows[i]) and bool(rows[j]) and lines.similar(rows[i], rows[j]) for i, j in zip(a, b)]
