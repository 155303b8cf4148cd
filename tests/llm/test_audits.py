"""Merkle manifest, source divergence and toxicity against plain Python and SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from parlance.llm import divergence, merkle, toxicity

from .fixtures import DOC_SCHEMA, documents, sentence_doc, vocabulary

ROWS = documents()
COLUMNS = [c.split()[0] for c in DOC_SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC_SCHEMA).repartition(3).cache()


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_proofs(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by the definition."""
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, src, n: H(text(i), text(src), text(lang), text(n), text(t))
    trees = defaultdict(list)
    for i, t, lang, src, n, *_ in rows:
        trees[lang].append(((i is not None, i or 0), leaf(i, t, lang, src, n), (i, t, lang, src, n)))
    for members in trees.values():
        members.sort(key=lambda x: x[:2])
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: climb([x[1] for x in trees[lang]]) for lang in order}
    top = climb([built[lang][-1][0] for lang in order])
    out = []
    for rank, lang in enumerate(order):
        for at, (_, own, (i, t, _, src, n)) in enumerate(trees[lang]):
            hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
            node, path = leaf(i, t, lang, src, n + 1) if hit else own, ""
            for levels, place in ((built[lang], at), (top, rank)):
                for level in levels[:-1]:
                    run = level[place // 2 * 2 : place // 2 * 2 + 2]
                    path += "".join(x for k, x in enumerate(run) if k != place % 2)
                    run[place % 2] = node
                    node, place = H(*run), place // 2
            out.append((i, own, built[lang][-1][0], top[-1][0], H(path), node, node == top[-1][0]))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("bits,limit", [(12, 1 << 14), (2, 5), (1, 3), (3, 1), (4, 20)])
def test_proofs(docs, bits, limit):
    got = merkle.proofs(docs, merkle.tampered(), bits, limit).collect()
    assert by_id(tuple(r) for r in got) == by_id(plain_proofs(ROWS))
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1


def test_proofs_without_changes(docs):
    assert all(r.verified for r in merkle.proofs(docs).collect())


def test_proofs_of_awkward_tables(spark):
    make = lambda rows: spark.createDataFrame([(*r, 1, "s", 1, 1, "t") for r in rows], DOC_SCHEMA)
    assert merkle.proofs(make([])).collect() == []
    for rows in (
        [(1, "one leaf", "en", "s", 8)],
        [(None, None, None, None, None)] * 5,
        [(k, "x", f"l{k}", None, 1) for k in range(40)],  # more languages than the driver takes
        [(7, "the same row", "en", "s", 12)] * 37 + [(3, "the same row", "", "s", None), (-2, "a\0b" * 2000, "é", "", 2**63 - 2), (5, "", "z", "", 0)],
    ):
        for bits, limit in ((12, 100), (2, 4)):
            got = merkle.proofs(make(rows), merkle.tampered(), bits, limit).collect()
            assert by_id(tuple(r) for r in got) == by_id(plain_proofs(rows))


@pytest.mark.parametrize("module,apply", [(merkle, lambda d: merkle.proofs(d, merkle.tampered(), 3, 7)), (divergence, divergence.divergences)])
def test_same_as_sql(spark, docs, module, apply):
    rows = [r for r in ROWS if r[0] is not None]
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    want, found = con.sql(module.SQL), apply(frame)
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert by_id(tuple(r) for r in found.select(*names).collect()) == by_id(want.fetchall())


# divergence


def plain_divergences(rows, least):
    words = [(t and re.sub("[A-Z]", lambda m: m[0].lower(), t) or "", lang or "", src or "") for t, lang, src in rows]
    words = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t), lang, src) for t, lang, src in words]
    out = []
    for lang in {x[1] for x in words}:
        held = Counter(w for ws, of, _ in words if of == lang for w in set(ws))
        kept = sorted(w for w, n in held.items() if n >= least)
        counts = defaultdict(Counter)
        for ws, of, src in words:
            if of == lang:
                counts[src].update(w for w in ws if held[w] >= least)
        total = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        q, p = shares(total), {src: shares(c) for src, c in counts.items()}
        for src in counts:
            pairs = [(sum(abs(p[src][w] - p[o][w]) for w in kept), o) for o in counts if o != src]
            own = [(p[src][w] - q[w], w) for w in kept if counts[src][w] and p[src][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", own, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, src, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return out


def audit_rows():
    rng = random.Random(4)
    rows = [(sentence_doc(rng, vocabulary(lang)[: 40 + 8 * s], rng.randint(0, 60)), lang, f"src{s}") for lang in ("en", "fr") for s in range(6) for _ in range(9)]
    rows += [(" ".join(vocabulary("en")[:60]) * 40, "en", "big")]  # a source whose shares of absent terms are the smallest
    rows += [(None, "en", "src1"), ("", "en", "empty"), ("12 34", "en", None), ("word wörd WORD İiİ x y", None, "s"), ("A" * 70000, "fr", "src2"), ("lone", "xx", "only")]
    rows += [("the same row again", "en", "src2")] * 31
    return rows + [("ties tie", "en", s) for s in ("ä", "z", "Z") for _ in range(3)]


@pytest.mark.parametrize("least", [1, 5, 30, 1000])
def test_divergences(spark, least, monkeypatch):
    rows = audit_rows()
    frame = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "text string, lang string, source string, term string, n long, p long").repartition(5)
    got = divergence.divergences(frame, least).select("lang", "source", "part", "item", "value", "rank").collect()
    want = sorted(plain_divergences(rows, least))
    assert sorted(tuple(r) for r in got) == want
    if least == 5:  # totals that are not broadcast, tiny runs of documents
        monkeypatch.setattr(divergence, "FEW", 0)
        monkeypatch.setattr(divergence, "ROWS", 3)
        assert sorted(tuple(r) for r in divergence.divergences(frame, least).select("lang", "source", "part", "item", "value", "rank").collect()) == want


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


# toxicity


def toxic_docs(n=500, seed=3):
    """Toxic English documents hold words of a list, toxic German ones inflections of a stem."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        words = rng.choices(vocabulary(lang, 2000), k=rng.randint(20, 90))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(3, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilegrub", "Mucklout", "SNARDLE"]) if lang == "en" else "grimpf" + rng.choice(vocabulary("de", 2000)))
        rows.append((i, " ".join(words) + ".", int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = toxic_docs()
    return toxicity.fit_texts([t for _, t, _ in rows], np.array([y == 1 for *_, y in rows]))


def test_held_out_toxicity(model):
    rows = toxic_docs(400, seed=9)
    x = toxicity.Words([t for _, t, _ in rows])
    p = model.marginals(x)
    said = model.score(x, p, len(rows)) >= 0.5
    bad = np.array([y == 1 for *_, y in rows])
    assert said[bad].mean() >= 0.95 and (~said[~bad]).mean() >= 0.98
    marked = Counter(t[a:b].lower()[:6] for (_, t, _), found in zip(rows, toxicity.spans(x, p, len(rows))) for a, b in found)
    assert set(w for w, _ in marked.most_common(4)) == {"vilegr", "mucklo", "snardl", "grimpf"} and sum(marked.values()) < 1.1 * sum(n for _, n in marked.most_common(4))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        e, first, stay = rng.normal(0, 2, n), np.append(True, rng.random(n - 1) < 0.3), (0.7, -0.4)
        total, weight = np.zeros(n), 0.0
        for bits in range(1 << n):
            y = np.array([bits >> k & 1 for k in range(n)])
            w = (e * y).sum() + sum(stay[y[k]] for k in range(1, n) if not first[k] and y[k] == y[k - 1])
            total += y * np.exp(w)
            weight += np.exp(w)
        ahead, behind = toxicity.messages(e, first, stay)
        assert np.allclose(1 / (1 + np.exp(-(ahead + e + behind))), total / weight)


def test_lanes_give_the_same_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    e, first = rng.normal(0, 3, 5000), rng.random(5000) < 0.002
    first[0] = True
    many = toxicity.messages(e, first, (1.5, -1.0))
    monkeypatch.setattr(toxicity, "LANES", 1)
    assert all(np.allclose(a, b) for a, b in zip(many, toxicity.messages(e, first, (1.5, -1.0))))


def test_words_and_features():
    x = toxicity.Words(["Ein Süßes, süßes 'Ding' x1y", "", "süßes"])
    text = ["Ein Süßes, süßes 'Ding' x1y", "", "süßes"]
    assert [text[t][a:b] for t, a, b in zip(x.text, x.start, x.end)] == ["Ein", "Süßes", "süßes", "Ding", "x", "y", "süßes"]
    assert x.form[1] == x.form[2] == x.form[6] and len(x.forms) == 5 and x.first.tolist() == [True, False, False, False, False, False, True]
    assert len(toxicity.Words([""]).form) == 0 and len(toxicity.Words(["", "12 !"]).form) == 0


def test_tags(spark, model):
    long = " ".join(random.Random(1).choices(vocabulary("en", 2000), k=30000))
    texts = [None, "", " \n", "12 -- 9", "vilegrub snardle you mucklout", "\U0001f600 vilegrub\n\nSNARDLE", long, "same", "same"]
    frame = spark.createDataFrame([(None if k == 3 else k, t, 9.0, "clash") for k, t in enumerate(texts)], "doc_id long, text string, toxic_score double, score string")
    got = toxicity.tag(frame, model).collect()
    assert len(got) == len(texts) and all(0 <= r.toxic_score <= 1 and r.score == "clash" for r in got)
    of = {r.text: r for r in got}
    assert of[""].toxic_score == of[None].toxic_score == of[" \n"].toxic_score == of["12 -- 9"].toxic_score < 0.5 and of[""].toxic_spans == []
    assert of[long].toxic_score < 0.5 < of[texts[4]].toxic_score
    assert [tuple(s) for s in of[texts[5]].toxic_spans] in ([(2, 10), (12, 19)], [(2, 19)])
    assert toxicity.tag(frame.limit(0), model).collect() == []


def test_fit_uses_training_rows_only(spark):
    rows = toxic_docs(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, "a second row of one id"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    flipped = spark.createDataFrame([(i, 0, 1 - y if (i, t, y) in held else y) for i, t, y in rows], "doc_id long, quality int, toxic int")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(one.weights, two.weights) and np.allclose(one.calibration, two.calibration)
    x = toxicity.Words([t for _, t, _ in held])
    said = one.score(x, one.marginals(x), len(held)) >= 0.5
    assert (said == np.array([y == 1 for *_, y in held])).mean() >= 0.95
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert [(r.toxic_score, r.toxic_spans) for r in toxicity.tag(docs.limit(3), none).collect()] == [(0.5, [])] * 3


def test_op12_contract(spark, tmp_path):
    rows = toxic_docs(120)
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.op12_toxicity(spark, str(tmp_path))
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int", "spans": "string"}
    for r in found.collect():
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
