"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, seed string, node long, n long, text_a string"


def vocabulary(lang: str, n: int = 300) -> list[str]:
    rng = random.Random(lang)
    parts = {"en": "th the er on an ing ed is ha in", "de": "sch ung keit ver ein der ich ge auf zu", "fr": "eau que les ment oi ou aux é è tion", "es": "ción que los ado mente ar os ñ ll la"}[lang].split()
    return ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]


def sentence_doc(rng: random.Random, words: list[str], n: int) -> str:
    out = rng.choices(words, k=n)
    return "\n".join(" ".join(out[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def documents(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr", "es")[i % 4]
        text = sentence_doc(rng, vocabulary(lang), rng.randint(20, 120))
        rows.append((i, text, lang))
    for i in range(n, n + 12):  # near copies: one or two words changed
        base = rows[i % 5][1].split(" ")
        for _ in range(1 + i % 2):
            base[rng.randrange(len(base))] = f"changed{i}"
        rows.append((i, " ".join(base), rows[i % 5][2]))
    rows += [(n + 20 + i, rows[3][1], "es") for i in range(25)]  # exact copies
    rows += [(n + 60, None, None), (n + 61, "", "en"), (n + 62, " \n\t ", "en"), (n + 63, "one two", "en"), (n + 64, "1234 !!! 99", "de"), (None, "no id here but words", "en"), (None, None, None)]
    rows += [(n + 70, "same row twice with words", "en")] * 2
    rows.append((n + 80, sentence_doc(rng, vocabulary("en"), 6000), "en"))
    return [(i, t, lang, "src0", len(t or ""), 7, "x", 1, 2, "clash") for i, t, lang in rows]
