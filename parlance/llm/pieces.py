"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of white-space markers with the characters up to the next marker (or up to a
line feed, which is a chunk of its own). When no piece of the vocabulary holds a marker after
another character, nor a line feed beside another character, merges never cross the border of
two chunks, so each distinct chunk is segmented once and the ids of a text are those of its
chunks, joined by position. ``check_vocabulary`` proves this for the model before use. The model reads a
space as a marker, so markers are written as spaces here: most chunks are then ASCII and decode to themselves,
and the table holds one string for both.

Each task keeps the table of the chunks that it has met, up to ``TABLE`` entries, then starts
anew; nothing is shuffled. A null text counts as empty: no ids, empty decoded text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import map_chunks, table

MARK = "▁"
TABLE = 250_000
CHUNK = re.compile("\n| *[^ \n]+| +")


def check_vocabulary(model) -> None:
    """Raise if a piece could cross the border of two chunks."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        if MARK in piece.lstrip(MARK) or ("\n" in piece and piece != "\n"):
            raise ValueError(f"piece {i} crosses a white-space marker or a line feed")


class ChunkTable:
    """Segments texts with one call of the model for each distinct chunk."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_vocabulary(self.model)
        if self.model.normalize("a  b\tÅﬁ ") not in (f"{MARK}a{MARK}{MARK}b\tÅﬁ{MARK}", "a  b\tÅﬁ "):
            raise ValueError("the model rewrites texts before it segments them")
        self.known: dict[str, tuple[str, int, str]] = {}
        lead = self.model.encode("\n")
        if len(lead) != 2 or not self.model.is_byte(lead[1]):
            raise ValueError("a line feed is not a byte piece of its own")
        self.feed = str(lead[1])
        self.known["\n"] = (self.feed, 1, "\n")

    def _segment(self, chunks: list[str]) -> None:
        """One call for all: line feeds, whose piece joins no other, keep the chunks apart."""
        if not chunks:
            return
        ids = self.model.encode("\n" + "\n".join(chunks), num_threads=1)
        each = ",".join(map(str, ids)).split(f",{self.feed},")[1:]
        surfaces = self.model.decode(ids).split("\n")[1:]
        for chunk, joined, surface in zip(chunks, each, surfaces, strict=True):
            self.known[chunk] = (joined, joined.count(",") + 1, chunk if surface == chunk else surface)

    def rows(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """Of each text: its ids joined by commas, their number, and the decoded text."""
        if len(self.known) > TABLE:
            self.known = {"\n": self.known["\n"]}
        cut = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = list({c for chunks in cut for c in chunks if c not in self.known})
        self._segment(new)
        known = self.known
        for chunks in cut:
            found = [known[c] for c in chunks]
            decoded = "".join([x[2] for x in found])
            yield ",".join([x[0] for x in found]), sum([x[1] for x in found]), decoded[1:] if decoded.startswith(" ") else decoded


def _rows_of(model_path: str):
    """``ChunkTable.rows`` with a table that lives as long as a task."""
    held: list[ChunkTable] = []

    def rows(texts: pd.Series) -> tuple:
        if not held:
            held.append(ChunkTable(model_path))
        return tuple(zip(*held[0].rows([t or "" for t in texts])))

    return rows


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` and ``decoded``. Columns of these names are replaced."""
    kept, rows = docs.drop("ids", "n_tokens", "decoded"), _rows_of(model_path)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        joined, count, back = rows(pdf[text_col])
        ids = [np.array(x.split(","), dtype=np.int32) if x else np.zeros(0, dtype=np.int32) for x in joined]
        return pdf.assign(ids=ids, n_tokens=count, decoded=back)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return map_chunks(kept, run, f"{ddl}, ids array<int>, n_tokens long, decoded string", rows=256)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """The number of ids and the SHA-256 of ids and decoded text of every document."""
    rows = _rows_of(model_path)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        joined, count, back = rows(pdf["text"])
        name = lambda texts: [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": count, "ids_sha256": name(joined), "decoded_sha256": name(back)})

    return map_chunks(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=256)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
