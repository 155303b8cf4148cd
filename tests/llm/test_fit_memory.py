"""What the fit of a language model holds in the driver."""

import tracemalloc

import numpy as np

from parlance.llm import language


def test_counts_stay_narrow_until_they_are_used():
    rng = np.random.default_rng(1)
    packed = [language.pack(rng.integers(0, 70_000, language.DIMENSIONS)) for _ in range(64)]
    assert [language.compact(p).dtype.itemsize for p in packed] == [2] * 64
    wide, narrow = ([(f"l{i // 2 % 2}", of(p), of(p)[::-1]) for i, p in enumerate(packed)] for of in (language.unpack, language.compact))
    found = []
    for rows in (wide, narrow):
        share, floor = language.calibrated(rows)
        found.append((share.tobytes(), floor))
    assert found[0] == found[1]
    tracemalloc.start()
    held = [language.compact(p) for p in packed]
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(held) == 64 and size < 64 * language.DIMENSIONS * 3


def test_the_driver_does_not_hold_the_sample(spark):
    rng = np.random.default_rng(2)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(80)] for lang, letters in (("en", "abcdefgh"), ("fi", "klmnopqr"))}
    rows = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(["en", "fi"] * 350)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()
    docs.count()
    tracemalloc.start()
    model = language.fit(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20  # the features of 560 texts are 18 MB
    assert [model.predict(text)[0] for _, text, _ in rows[:20]] == [lang for _, _, lang in rows[:20]]
    assert model.known(rows[0][1])
