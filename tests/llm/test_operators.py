"""Each operator against brute force, and its defined results for nulls, empty tables and repeated rows."""

import base64
import gzip
import hashlib
import math
import random
import textwrap
import time
import urllib.parse
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parlance.llm import components, fingerprints, language, leaks, licences, lines, near, pieces, quality, secrets, sharding

from .fixtures import DOC_SCHEMA, documents, sentence_doc, vocabulary

ROWS = documents()
BY_ID = sorted(((r[0], r[1]) for r in ROWS if r[0] is not None), key=lambda r: r[0])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*[w[j:] for j in range(k)]))


def least_reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# 1. fingerprints


def test_edits_and_likeness(docs):
    got = fingerprints.compare_with_edits(docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(((i, t or "") for i, t in BY_ID), key=lambda r: (-r[0], r[1]))
    after = {k: order[(k + 1) % len(order)][1] for k in range(len(order))}
    want = defaultdict(list)
    for k, (i, t) in enumerate(order):
        h = len(t) // 2
        want[i].append((hashlib.sha256((t[: len(t) - h] + after[k][:h]).encode()).hexdigest(), len(t)))
    rows = defaultdict(list)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            rows[r.doc_id].append((r.edited_sha256, r.n_chars))
    assert {k: sorted(v) for k, v in rows.items()} == {k: sorted(v) for k, v in want.items()}
    first = order[0][1]
    for r in got:
        if r.doc_id is None:
            t = next(x[1] for x in ROWS if x[0] is None and len(x[1] or "") == r.n_chars) or ""
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + first[: len(t) // 2]).encode()).hexdigest()
    prints = {r.doc_id: r.fingerprint for r in got}
    assert len({prints[60 + 20 + i] for i in range(25)}) == 1
    for k, (i, t) in enumerate(order):
        exact = shingles(t, 5), shingles(after[k], 5)
        if len(exact[0] | exact[1]) <= fingerprints.K and len(want[i]) == 1:
            r = next(x for x in got if x.doc_id == i and x.n_chars == len(t))
            union = exact[0] | exact[1]
            assert r.near_next == pytest.approx(len(exact[0] & exact[1]) / len(union) if union else 1.0)


def test_fingerprints_merge(spark, docs):
    from pyspark.sql import functions as F

    made = fingerprints.with_fingerprint(docs.where("doc_id < 8").select("doc_id", "text"), F.col("text"), "fp")
    merged = fingerprints.merged_by(made.withColumn("g", F.lit(1)), ["g"], "fp").head().fp
    hashes = sorted({h for r in made.collect() for h in r.fp})
    assert merged == hashes[: fingerprints.K]
    pair = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5, 6]), ([], []), ([], [1])], "a array<long>, b array<long>")
    out = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.r, r.c) for r in out] == [(pytest.approx(1 / 3), pytest.approx(0.5)), (1.0, 1.0), (0.0, 1.0)]
    assert fingerprints.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("ids", [[*range(2000), 10**15], [-(2**62) - 5, 2**62 + 5, 0, -(2**63), 2**63 - 1], [7] * 900 + [8, 9]])
def test_order_by_id_is_cut_evenly(spark, ids):
    """Outlying, extreme and repeated ids: every row meets its next, and no range holds more than a small share."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, f"text {k} of the row") for k, i in enumerate(ids)], "doc_id long, text string")
    got = fingerprints.compare_with_edits(rows).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids)
    texts = {hashlib.sha256(t.encode()).hexdigest() for t in edited(rows.withColumn("h", F.xxhash64("text")).collect())}
    assert {r.edited_sha256 for r in got} == texts
    placed = fingerprints.with_neighbours(rows.withColumn("_h", F.xxhash64("text")))
    assert placed.where("not _copy").groupBy("_bucket").count().agg(F.max("count")).head()[0] <= max(4, len(ids) // 50)


def edited(rows):
    """Each text with its second half replaced by the beginning of the next one's, in the operator's order."""
    rows = sorted(rows, key=lambda r: (-r.doc_id, r.h))
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        half = len(r.text) // 2
        yield r.text[: len(r.text) - half] + after.text[:half]


# 2. licences


def test_licences(spark):
    long_mit = "Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "Words first. Licensed under the Apache License, Version 2.0. More words"), (2, long_mit), (3, None), (4, ""), (None, "Released under the MIT License."), (5, "Copyright 2020 X\nAll rights reserved."), (6, "a licence of my own"), (1, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    got = licences.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sentence_ids string")).collect()
    named = [(r.doc_id, r.licences) for r in got]
    assert named == [(1, ["Apache-2.0"]), (2, ["MIT"]), (3, []), (4, []), (None, ["MIT"]), (5, ["Proprietary"]), (6, []), (1, ["MIT", "CC-BY-NC-4.0"])]
    assert got[1].sentence_ids == ["copyright", "mit_grant", "mit_notice"]
    import re

    assert all(re.search(licences.ANCHORS, s) for s in licences.SENTENCES.values())


MIT = """Copyright (c) 2020 A. Person
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."

LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""


def test_wrapped_licences(spark):
    want = {
        LGPL: (["lgpl21_library", "lgpl_warranty"], ["LGPL-2.1-or-later"]), UNLICENSE: (["unlicense_free", "unlicense_anyone"], ["Unlicense"]),
        APACHE: (["apache2_under_the_license", "apache2_comply", "apache2_copy_at", "apache2_unless", "apache2_see"], ["Apache-2.0"]),
        MIT: (["copyright", "mit_grant", "mit_notice", "as_is"], ["MIT"]), BSD: (["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_name"], ["BSD-3-Clause"]),
        GPL: (["gpl3_program", "gpl_warranty"], ["GPL-3.0-or-later"]), MPL: (["mpl2_source"], ["MPL-2.0"]),
    }
    rows, expected = [], []
    for text, found in want.items():
        for leader, end, width in (("", "\n", 72), (" * ", "\n", 78), ("# ", "\r\n", 70), ("// ", "\n", 76), ("", "\n", 10000)):
            lines_of = [part for line in text.split("\n") for part in textwrap.wrap(line, width) or [""]]
            rows.append((len(rows), end.join((leader + line).rstrip() for line in ["Some words", "", *lines_of, "", "more"])))
            expected.append(found)
    rows += [(len(rows), "Released under\n\nthe MIT License."), (len(rows) + 1, "Released under. The MIT License."), (len(rows) + 2, "It was released under\nthe MIT License.")]
    got = sorted(licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r.sentence_ids, r.licences) for r in got] == [*expected, *[([], [])] * 3]


# 3. secrets


@pytest.mark.parametrize("wrap", [
    lambda s: s, lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"%{b:02X}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(zlib.compress(s.encode())).decode(),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(), lambda s: base64.b64encode(urllib.parse.quote(s, safe="").encode()).decode(),
])
def test_layers(wrap):
    blob = wrap("password=hunter22secret")
    text = f"Ünï before {blob} after"
    base, spans = secrets.scan(text)
    assert set(base) <= set(spans)
    start = text.index(blob)
    assert any(kind == 0 and low == start and high <= start + len(blob) for low, kind, high in spans)


def test_base_rules_and_cycles():
    text = 'TOKEN: "abcdef" token=abc AKIA' + "A" * 15 + " AKIA" + "B" * 16 + " " + "f" * 23 + "g " + "0" * 24 + " token: token: abcdefgh"
    base, _ = secrets.scan(text)
    assert [secrets.KINDS[k] for _, k, _ in base] == ["assign", "access", "hex"]
    assert secrets.scan("%2541 " * 3 + "%25" * 50)[0] == []
    assert secrets.scan("") == ([], [])


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_repeated_blobs(pack):
    blob = base64.b64encode(pack(b"password=hunter22secret"))
    text = f"a {blob.decode()} b\n" * 3
    _, spans = secrets.scan(text)
    line = len(text) // 3
    assert len(spans) == 3 and [s % line for s, _, _ in spans] == [spans[0][0]] * 3


def _wrapped(data: bytes, width: int, end: str = "\n") -> str:
    blob = base64.b64encode(data).decode()
    return end.join(blob[i : i + width] for i in range(0, len(blob), width))


NOISE = "".join(chr(97 + random.Random(5).randrange(26)) if i % 7 else " " for i in range(300))


@pytest.mark.parametrize("blob", [
    *[glue + base64.b64encode(pack(b"password=hunter22secret")).decode() for glue in ("/v1/cb/", "key-", "x_", "ab+", "/v1/c/", "/v1/cbd/") for pack in (bytes, gzip.compress, zlib.compress)],
    base64.b64encode(gzip.compress(gzip.compress(b"password=hunter22secret"))).decode(),
    base64.b64encode(zlib.compress(gzip.compress(zlib.compress(b"password=hunter22secret")))).decode(),
    base64.b64encode(gzip.compress(b"first") + gzip.compress(b" password=hunter") + gzip.compress(b"22secret")).decode(),
    *[_wrapped(pack((NOISE[:k] + "password=hunter22secret" + NOISE).encode()), width, end) for pack in (bytes, gzip.compress) for width in (64, 76) for end in ("\n", "\r\n  ") for k in (20, 39, 48)],
])
def test_unwrapped_to_the_end(blob):
    text = f"Ünï before\n{blob}\nafter"
    start = text.index(blob)
    whole = [(low, high) for low, kind, high in secrets.scan(text)[1] if kind == 0 and low >= start and high <= start + len(blob)]
    assert whole
    # The span covers all of the secret: 23 bytes of base64, or the whole stream.
    assert max(high - low for low, high in whole) >= 31


def test_unwrapping_ends():
    for text in (base64.b64encode(zlib.compress(bytes(secrets.MAX_LAYER + 1))).decode(), "A/" * 5000, "x_eJ" * 3000, ("Abcd" * 19 + "\n") * 200):
        assert secrets.scan(text) == ([], [])


@pytest.mark.parametrize("sign", ["%" + "25" * 50_000 + "3D", "\\" + "u005c" * 20_000 + "u003d", "&" + "#38;" * 25_000 + "#61;"])
def test_long_chains_of_escapes(sign):
    """The whole chain stands for one character, and its length costs no layers."""
    began = time.time()
    text = f"password{sign}hunter22secret"
    assert (0, 0, len(text)) in secrets.scan(text)[1]
    assert time.time() - began < 5


def test_find_secrets(spark, docs, empty):
    got = secrets.find_secrets(spark.createDataFrame([(None, "token=abcdefgh", 1), (9007199254740993, None, 2), (3, "", 3)], "doc_id long, text string, spans int")).collect()
    assert [(r.doc_id, len(r.base), len(r.spans)) for r in got] == [(None, 1, 1), (9007199254740993, 0, 0), (3, 0, 0)]
    assert secrets.find_secrets(docs).count() == len(ROWS) and secrets.find_secrets(empty).count() == 0


# 4. language


def test_language(spark):
    rng = random.Random(3)
    rows = [(i, sentence_doc(rng, vocabulary(lang), 60), lang) for i in range(200) for lang in [("en", "de", "fr", "es")[i % 4]]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !!", None), (None, rows[0][1], "en"), (None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    got = language.predict(df, language.fit(df)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 20
    assert [r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r.lang_score <= 1 for r in got)
    nothing = language.fit(df.where("false"))
    assert {(r.lang_pred, r.lang_known) for r in language.predict(df, nothing).collect()} == {("und", True), ("und", False)}


def test_unknown_languages_and_letters(spark):
    """Long texts in no learned language are told, short ones get the benefit of the doubt; fractions and circled digits are no letters; no language is left out."""
    rng = random.Random(13)
    rows = [(i, sentence_doc(rng, vocabulary(lang), 60), lang) for i in range(200) for lang in [("en", "de", "fr", "es")[i % 4]]]
    odd = ["привет как дела сегодня хорошо " * 8, "這是一個中文句子，沒有學過的語言。" * 6, "xqz vvk", "½ ² ①"]
    got = language.predict(spark.createDataFrame([*rows, *[(1000 + k, t, None) for k, t in enumerate(odd)]], "doc_id long, text string, lang string"), language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    known = {r.doc_id: (r.lang_known, r.lang_pred) for r in got.collect()}
    assert all(known[i][0] for i in range(200)) and [known[1000 + k][0] for k in range(4)] == [False, False, True, False] and known[1003][1] == "und"
    many = [(i, f"word{i % 60} " * 5, f"l{i % 60:02d}") for i in range(300)]
    assert len([m for f in language.fit(spark.createDataFrame(many, "doc_id long, text string, lang string")).members.values() for m in f]) == 60


def test_rejection_rates(spark):
    """Gibberish in Latin letters and a language left out are rejected in nine of ten cases, texts in learned languages in at most one of a hundred."""
    rng = random.Random(17)
    rows = [(i, sentence_doc(rng, vocabulary(lang, 2000), 60), lang) for i in range(900) for lang in [("en", "de", "fr")[i % 3]]]
    learned, fresh = rows[:600], [t for _, t, _ in rows[600:]]
    mixed = [a[: len(a) // 2] + "\n" + b[: len(b) // 2] + "\ntoken = dfd1944d2e84f15e89902e34b677eb5a +1 (168) 555-5254" for a, b in zip(fresh[:100], fresh[101:201])]
    gibberish = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 80))) for _ in range(100)]
    other = [sentence_doc(rng, vocabulary("es", 2000), 60) for _ in range(100)]
    model = language.fit(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    rate = lambda texts: sum(model.predict(t)[2] for t in texts) / len(texts)
    assert rate(fresh) >= 0.99 and rate(mixed) >= 0.99 and rate(gibberish) <= 0.1 and rate(other) <= 0.1
    assert rate([language.shuffled(t) for t in fresh]) <= 0.1 and model.predict("x" * 50)[2]


# 5. sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, inverse=True) == np.arange(n)).all()
    shard, slot = sharding.locate(np.arange(n), n, 7)
    assert (sharding.row_at(shard, slot, n, 7) == np.arange(n)).all()


def test_shards(docs, empty):
    got = sharding.shard(docs, 7).toPandas()
    again = sharding.shard(docs.repartition(5), 7).toPandas()
    assert len(got) == len(ROWS) and sorted(got.row_number) == list(range(len(ROWS)))
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["nunique"]).all()
    key = ["doc_id", "text_crc32", "shard", "slot"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert sorted(got.text_crc32) == sorted(zlib.crc32((r[1] or "").encode()) for r in ROWS)
    assert sorted(got["size"]) == sorted(len((r[1] or "").encode()) + 8 for r in ROWS)
    assert sharding.shard(empty, 7).count() == 0


# 6. near duplicates


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, words, percent):
    got = near.near_duplicates(docs, words, percent).collect()
    assert len(got) == len(ROWS)
    sets = {i: shingles(t, words) for i, t in BY_ID}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = least_reachable(ids, links)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id]) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near.near_duplicates(empty, words, percent).count() == 0


def test_large_bucket_is_exact(spark):
    """A group of near copies larger than a small bucket, with copies that only some others reach."""
    rng = random.Random(5)
    base = rng.choices(vocabulary("en", 2000), k=120)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t, 3) for i, t in rows}
    want = least_reachable(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert 1 < len(set(want.values())) < 150


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, 500), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    real = [(a, b) for a, b in chain if a is not None]
    assert got == least_reachable({n for e in real for n in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7. leaks


def test_leaks(spark, empty):
    rng = random.Random(4)
    words = vocabulary("en", 3000)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(12, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short here")]
    items += [(90, items[0][1])]
    docs, want = [], set()
    for i in range(60):
        body = rng.choices(words, k=80)
        if i % 3 == 0:
            item = items[i % 12][1].split()
            if i % 2:
                item[6] = "substituted"
            body[30:30] = item
            want.add((i, i % 12))
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (None, "x " + items[1][1]), (102, items[2][1]), (102, items[2][1])]
    want |= {(None, 1), (102, 2)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find_leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert leaks.find_leaks(empty, bench).count() == 0
    assert leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench.where("false")).count() == 0


def leaked_tokens(doc, item):
    """Equal tokens of the best run over all alignments, by brute force."""
    run = min(leaks.WINDOW, len(item))
    best = 0
    for offset in range(-len(item), len(doc)):
        same = [0 <= offset + i < len(doc) and doc[offset + i] == w for i, w in enumerate(item)]
        best = max(best, max(sum(same[s : s + run]) for s in range(len(item) - run + 1)))
    return best, run


@pytest.mark.parametrize("most", [leaks.BROADCAST, 0])
def test_leaks_against_all_alignments(spark, monkeypatch, most):
    """Also where the seeds are too many to broadcast."""
    monkeypatch.setattr(leaks, "BROADCAST", most)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    items = [(n * 10 + k, rng.choices(words, k=n)) for n in range(1, 24) for k in range(2)]
    docs = []
    for i, (_, item) in enumerate(items * 3):
        quoted = list(item)
        for at in rng.sample(range(len(item)), min(len(item), rng.randint(0, 1 + len(item) // 4))):
            quoted[at] = "changed"
        body = rng.choices(words, k=rng.randint(0, 20))
        at = rng.randint(0, len(body))
        docs.append((None if i % 7 == 0 else i, [*body[:at], *quoted, *body[at:]]))
    want = set()
    for i, doc in docs:
        for k, item in items:
            best, run = leaked_tokens(doc, item)
            if best == run if len(item) < leaks.WHOLE else 100 * best >= leaks.PERCENT * run:
                want.add((i, k))
    made = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    got = leaks.find_leaks(made, spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 60


# 8. pieces


def test_pieces(docs, spark, empty):
    model = pieces.ChunkTable(pieces.model_path()).model
    hard = ["", "  a\n b\tc 𝔘 <s>", "\n\n x", "▁▁a b", "a ▁b", " ", "\n", " \n", "a\n", "hello   world \n\n  foo\x00bar　é ﬁ", "a\r\nb", "日本語 テスト\n日本 ​", "x" * 5000, None]
    table = pieces.ChunkTable(pieces.model_path())
    for text, (joined, n, back) in zip(hard, table.rows([t or "" for t in hard])):
        ids = model.encode(text or "")
        assert joined == ",".join(map(str, ids)) and n == len(ids) and back == model.decode(ids)
    got = pieces.encode(docs.withColumnRenamed("seed", "ids"), pieces.model_path()).collect()
    assert len(got) == len(ROWS) and all(r.ids == model.encode(r.text or "") and r.decoded == (r.text or "") for r in got)
    assert pieces.digests(empty, pieces.model_path()).count() == 0


# 9. quality


def test_marginals_are_exact():
    rng = random.Random(1)
    for _ in range(30):
        scores, stay = [rng.gauss(0, 2) for _ in range(rng.randint(1, 7))], (rng.gauss(0, 1), rng.gauss(0, 1))
        total, good = 0.0, [0.0] * len(scores)
        for code in range(1 << len(scores)):
            y = [code >> t & 1 for t in range(len(scores))]
            weight = math.exp(sum(s for s, v in zip(scores, y) if v) + sum(stay[a] for a, b in zip(y, y[1:]) if a == b))
            total += weight
            for t, v in enumerate(y):
                good[t] += weight * v
        assert quality.marginals(scores, stay) == pytest.approx([g / total for g in good])


def test_line_scores_equal_the_wide_table():
    rng = np.random.default_rng(3)
    texts = ["one line", "a\nb c\n\nd e f", "", "x\ny"]
    own, size, first = quality.line_features(texts)
    wide = quality.with_neighbours(own, first)
    w, mean, scale = rng.normal(size=wide.shape[1]), rng.normal(size=wide.shape[1]), rng.uniform(1, 2, wide.shape[1])
    mean[-3], scale[-3] = 0, 1
    model = quality.Model(w, (0.0, 0.0), mean, scale, (1.0, 0.0))
    assert np.allclose(model.line_scores(own, first), ((wide - mean) / scale) @ w)


def test_long_and_repeated_training_texts_are_left_out(spark):
    rows = [(i, "good words here\nand there" if i % 2 else "### $$$ ###\n%%%") for i in range(60)]
    more = [(500, "\n".join(["line"] * (quality.DOC_LINES + 1))), *[(502, "same id")] * 30]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(500, 1), (502, 0)], "doc_id long, quality int")
    a, b = (quality.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows + more))
    assert np.allclose(a.weights, b.weights) and a.calibration == pytest.approx(b.calibration)
    assert len(quality.Model.score(a, ["a b\n" * 200_000, ""])) == 2


def test_quality(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = sentence_doc(rng, vocabulary("en"), 40) if good else "\n".join(" ".join(f"{w}$$$" for w in rng.choices(vocabulary("en"), k=9)) for _ in range(4))
        rows.append((i, text))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (None, "x"), (5, rows[5][1])]
    labels += [(2, 0), (None, 1), (77777, 1), (3, None)]
    docs, marks = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, quality_score double"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [(got[i], q) for i, q in labels[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.5) == bool(q) for s, q in held) >= 0.95 * len(held) > 50
    plain = quality.fit(docs, marks.where("false"))
    assert {r.quality_score for r in quality.score(docs, plain).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


# 10. lines


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert lines.edit_distance(a, b) == row[-1]


def blocks(line):
    return lines.unpacked(lines.line_table([line]).column("blocks"))[0].tolist()


def test_blocks():
    """A long line's block is the majority of three words' bits; a short line's that of all words but one."""
    short = "alpha beta gamma delta epsilon zeta".split()
    whole = blocks(" ".join(short))
    assert len(set(whole)) == 7
    for i in range(6):
        changed, fewer = [*short[:i], "other", *short[i + 1 :]], [*short[:i], *short[i + 1 :]]
        assert whole[i] in blocks(" ".join(changed)) and whole[i] in blocks(" ".join(fewer))
    for n, many in ((7, 8), (8, 12 + 9), (9, 12 + 10), (10, 12), (19, 12), (20, 9), (300, 9)):
        assert len(blocks(" ".join(f"word{k}" for k in range(n)))) == many
    assert blocks("the the the the the") and blocks(" ".join(["a"] * 40))  # fewer than three words to vote
    assert not len(lines.line_table(["too short to count"]))


@pytest.mark.parametrize("n, changed", [(5, 1), (7, 1), (8, 1), (10, 2), (12, 1), (15, 3), (20, 1), (20, 4), (50, 1), (50, 10), (100, 1), (100, 20)])
def test_recall_of_similar_lines(n, changed):
    """Of pairs at the least similarity that is wanted, nine of ten become candidates: no shared block is presupposed."""
    rng, words = random.Random(n + changed), vocabulary("en", 4000)
    found, tries = 0, 600
    for _ in range(tries):
        a = rng.choices(words, k=n)
        b = list(a)
        for at in rng.sample(range(n), changed):
            b[at] = rng.choice(words)
        x, y = blocks(" ".join(a)), blocks(" ".join(b))
        assert lines.similar(a, b)
        found += bool(set(x) & set(y))
    assert found >= (0.9 if n > lines.SHORT else 1.0) * tries


def test_lines(spark, empty):
    rng = random.Random(9)
    wide = rng.choices(vocabulary("en", 2000), k=150)
    rows = [*ROWS]
    for i in range(30):  # long lines that differ in a word, in one bucket or another
        w = list(wide)
        w[5 * i] = "an"
        rows.append((300 + i, " ".join(w) + "\nshort line", "en", "src0", 1, 7, "x", 1, 2, "clash"))
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = lines.deduplicate_lines(docs.withColumnRenamed("key", "n_lines")).collect()
    assert len(got) == len(rows)
    per_doc = defaultdict(list)
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        if t is not None:
            per_doc[i] = t.split("\n")
    keyed, first = {}, {}
    for i in sorted(per_doc):
        for k, line in enumerate(per_doc[i]):
            words = lines.folded([line]).tobytes().split()
            if len(words) >= lines.MIN_WORDS:
                first.setdefault(tuple(words), (i, k))
                keyed[i, k] = tuple(words)
    kinds = list(first)
    links = [(x, y) for x in range(len(kinds)) for y in range(x) if lines.similar(list(kinds[x]), list(kinds[y]))]
    root = least_reachable(range(len(kinds)), links)
    place = {w: n for n, w in enumerate(kinds)}
    keep = {}
    for w, at in first.items():
        keep[root[place[w]]] = min(keep.get(root[place[w]], at), at)
    assert links
    want = {i: "\n".join(line for k, line in enumerate(ls) if (i, k) not in keyed or keep[root[place[keyed[i, k]]]] == (i, k)) for i, ls in per_doc.items()}
    for r in got:
        if r.doc_id is None or r.doc_id not in want:
            assert r.n_removed == 0
        else:
            assert r.text == want[r.doc_id]
            assert r.n_removed == len(per_doc[r.doc_id]) - len(r.text.split("\n")) or r.text == ""
    assert lines.deduplicate_lines(empty).count() == 0
