"""The registered queries on small tables: their columns, and what their contracts fix, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from parlance.llm import pieces
from parlance.llm.queries import QUERIES

from .fixtures import documents, sentence_doc, vocabulary

ROWS = [(i, t, lang, src, n) for i, t, lang, src, n, *_ in documents()]
ROWS += [(150, 'password = "hunter22" token:abc AKIA' + "Q" * 16 + " " + "ab12" * 7, "en", "s", 1), (151, "api_key:zzzzzzzz %70assword%3Dhunter22secret", "en", "s", 1)]
WITH_ID = [r for r in ROWS if r[0] is not None]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    marks = [(r[0], r[0] % 2, 0) for r in WITH_ID if r[0] % 4 < 3]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(k, " ".join((ROWS[k][1] or "").split()[3:23])) for k in range(3)] + [(9, sentence_doc(rng, vocabulary("en", 3000), 20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(spark, tables, name, columns):
    found = QUERIES[name](spark, tables)
    types = dict(found.dtypes)
    for column, kind in (c.split() for c in columns.split(", ")):
        assert types[column] == {"long": "bigint"}.get(kind, kind), column
    return found.collect()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_op1(spark, tables):
    got = rows_of(spark, tables, "op1_fingerprints", "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = sorted(((i, t or "") for i, t, *_ in WITH_ID), key=lambda r: -r[0])
    want = Counter()
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        want[i, len(t), digest(t[: len(t) - half] + after[:half])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == want and len(got) == len(ROWS)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and 0 <= r.contained_in_edited <= 1
    for (i, t, *_), r in zip(sorted(WITH_ID), sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)):
        assert prints.setdefault(t or "", r.fingerprint) == r.fingerprint


def test_op2(spark, tables):
    assert len(rows_of(spark, tables, "op2_licences", "doc_id long, n_sentences long, sentence_ids string, licences string")) == len(ROWS)


def base_by_contract(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_op3(spark, tables):
    got = rows_of(spark, tables, "op3_secrets", "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    want = Counter()
    for i, t, *_ in ROWS:
        base = base_by_contract(t or "")
        kinds = Counter(k for _, k, _ in base)
        want[i, kinds[0], kinds[1], kinds[2], digest(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    by_id = {r.doc_id: r.spans for r in got}
    assert by_id[150].count(":") == 6 and by_id[151].startswith("assign:0:16,assign:17:")


def test_op4(spark, tables):
    got = rows_of(spark, tables, "op4_language", "doc_id long, held_out boolean, lang_pred string, score double")
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 5) == 0) for r in got)
    texts = {i: t for i, t, *_ in WITH_ID}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in got if r.doc_id is not None)


def test_op5(spark, tables):
    got = rows_of(spark, tables, "op5_sharding", "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(s, k) for s, n in counts.items() for k in range(n)}


def test_op6(spark, tables):
    got = rows_of(spark, tables, "op6_near_duplicates", "doc_id long, n_shingles long, component_id long, kept boolean")
    sets = {}
    for i, t, *_ in WITH_ID:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset([tuple(w)]) if 0 < len(w) < 3 else frozenset(zip(w, w[1:], w[2:]))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), r.doc_id == find(r.doc_id))


def test_op7(spark, tables):
    got = rows_of(spark, tables, "op7_decontamination", "doc_id long, item_id long")
    assert {(k, k) for k in range(3)} <= {(r.doc_id, r.item_id) for r in got} and not any(r.item_id == 9 for r in got)


def test_op8(spark, tables):
    got = rows_of(spark, tables, "op8_sentencepiece", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    model = pieces.ChunkTable(pieces.model_path()).model
    want = Counter()
    for i, t, *_ in ROWS:
        ids = model.encode(t or "")
        want[i, len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids))] += 1
    assert Counter(tuple(r)[:4] for r in got) == want


def test_op8_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE", 5)
    table = pieces.ChunkTable(pieces.model_path())
    texts = [t or "" for _, t, *_ in ROWS[:40]]
    assert [row for t in texts for row in table.rows([t])] == [(",".join(map(str, ids)), len(ids), table.model.decode(ids)) for ids in map(table.model.encode, texts)]


def test_op9(spark, tables):
    got = rows_of(spark, tables, "op9_quality", "doc_id long, held_out boolean, score double, predicted int")
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1) for r in got)


def test_op10(spark, tables):
    got = rows_of(spark, tables, "op10_lines", "doc_id long, n_lines long, n_removed long, text_sha256 string, n_chars long")
    texts = {i: t or "" for i, t, *_ in WITH_ID}
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None and not r.n_removed:
            assert (r.text_sha256, r.n_chars) == (digest(texts[r.doc_id]), len(texts[r.doc_id]))
    assert sum(r.n_removed for r in got) >= 25 * 2  # the exact copies lose all lines of five words or more
