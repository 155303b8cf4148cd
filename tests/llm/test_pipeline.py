"""The pipeline end to end on a small corpus, each stage checked against what it must drop and keep."""

import random

import corpus_pipeline
from parlance.llm import pieces

from .fixtures import sentence_doc, vocabulary


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    langs = ("en", "de", "fr", "es")
    clean = [(i, sentence_doc(rng, vocabulary(langs[i % 4], 2000), 80), langs[i % 4]) for i in range(120)]
    items = [(k, " ".join(rng.choices(vocabulary("en", 3000), k=20))) for k in range(4)]
    leaked = [(200 + k, sentence_doc(rng, vocabulary("en", 2000), 30) + "\n" + items[k][1], "en") for k in range(4)]
    copies = [(300 + k, clean[k][1], clean[k][2]) for k in range(5)]
    words = clean[10][1].replace("\n", " ").split(" ")
    broken = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    near = [(400 + k, broken([*words[: 10 + k], "else", *words[11 + k :]], 13 + 4 * k), clean[10][2]) for k in range(5)]  # other lines, nearly the same words
    boiler = "This very line stands in many of the documents here."
    lined = [(500 + k, clean_text + "\n" + boiler, "en") for k, clean_text in enumerate(sentence_doc(rng, vocabulary("en", 2000), 40) for _ in range(5))]
    junk = [(600, None, None), (601, "123 456 !!!", "en"), (602, "", "de"), (603, "привет как дела сегодня хорошо " * 8, None)]
    again = [(700, sentence_doc(rng, vocabulary("en", 2000), 60), "en")] * 3  # one row, three times
    nameless = [(None, sentence_doc(rng, vocabulary("de", 2000), 60), None), (None, sentence_doc(rng, vocabulary("en", 2000), 30) + "\n" + items[0][1], "en")]
    rows = [(i, t, lang, "src", len(t or "")) for i, t, lang in clean + leaked + copies + near + lined + junk + again + nameless]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            rows_left = docs.collect()
            kept.append({r.doc_id: r.text for r in rows_left})
            assert sum(r.doc_id == 700 for r in rows_left) == (3 if k < 2 else 1) and sum(r.doc_id is None for r in rows_left) == (2 if k < 3 else 1)
            assert all(r.lang for r in rows_left)
        else:
            last = out.collect()
    everything = {r[0] for r in rows}
    assert set(kept[0]) == everything - {600, 601, 602, 603}
    assert set(kept[1]) == set(kept[0]) - {300, 301, 302, 303, 304}
    assert sum(boiler in t for t in kept[1].values()) == 1 and boiler in kept[1][500]
    assert set(kept[2]) == set(kept[1]) - {400, 401, 402, 403, 404}
    assert set(kept[3]) == set(kept[2]) - {200, 201, 202, 203}
    assert {i for i, _, _ in clean} <= set(kept[3])
    model = pieces.ChunkTable(pieces.model_path()).model
    assert {r.doc_id: r.ids for r in last} == {i: model.encode(t) for i, t in kept[3].items()} and all(r.round_trip for r in last)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(map(str, kept[3]))


def test_empty_tables(spark, tmp_path):
    """No documents, no benchmark: every stage gives no rows and keeps the columns."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
