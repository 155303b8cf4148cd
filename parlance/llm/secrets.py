r"""Secret scans with a worklist of decoded layers.

A text is layer 0. Each layer is scanned for the base kinds; then its encoded stretches (percent
escapes, Unicode escapes, base64 (also wrapped over lines, or with other characters before or
after it), and gzip or zlib data inside base64, however often packed) are unwrapped into new
layers that join the worklist, until no layer gives a new one. A layer whose content was met
before at the same span of the text is not opened again, so cycles end. A chain of escaped escape
signs (``%252525..``, ``\u005cu005c..``, ``&#38;#38;..``) is undone in one step, so that its length
costs no layers; a layer's text is dropped once it has been scanned. Words of lower-case letters
only (or of title case) and runs of hexadecimal digits are not opened as base64: the chance that 16
characters of base64 look like that is under one in a million. Every position of a layer maps to a
stretch of the layer above, so a find at any depth is reported as a span of the whole text.

Base kinds, each leftmost and non-overlapping: ``assign`` (group 2 of 6 characters or more),
``access`` (20 or more in all), ``hex`` (24 or more). Finds inside decoded layers add spans and
never remove base ones. A null text counts as empty; an empty text has no spans. A compressed
stream that would unwrap to more than ``MAX_LAYER`` bytes is refused as a bomb: its carrier is
still scanned as text. Rows keep their ids, repeated or null; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import map_chunks, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run that fails its length cannot hide a longer one, so the length is part of these two.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
# An escape's own sign may be escaped any number of times: (?:25)*, (?:u005c|...)* and (?:#38;|...)* are such chains.
PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
PERCENTS = re.compile(rf"(?:{PERCENT.pattern.replace('(?:25)*(', '(?:25)*(?:')})+")
UNICODE = re.compile(
    r"\\(?:u005[Cc]|x5[Cc]|u\{0{0,4}5[Cc]\})*(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))"
    r"|&(?:#38;|#[xX]26;)*(?:#([0-9]{1,7});|#[xX]([0-9A-Fa-f]{1,6});)"
)
# Runs that lines end or fill are one candidate: base64 wrapped at any width. The last line may be short.
BASE64 = re.compile(
    r"[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,}+(?=[ \t]*(?:\r?\n|$)|=))*+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++(?=[ \t]*(?:\r?\n|$)|=))?={0,2}"
)
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Least bytes of text in a run that is not text as a whole: those of 16 characters.
LEAST = 12
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
MAX_LAYER = 64 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, place of the kind in ``KINDS``, end."""
    found = []
    if KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A decoded text; pieces say where its stretches come from in the layer above."""

    def __init__(self, text: str, starts: list[int], sources: list[tuple[int, int, bool]], parent: Layer | None):
        self.text, self.starts, self.sources, self.parent = text, starts, sources, parent

    def to_root(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer._place(start)[0], layer._place(end - 1)[1]
            layer = layer.parent
        return start, end

    def _place(self, at: int) -> tuple[int, int]:
        """The stretch of the layer above that one character comes from; a literal piece maps by offset."""
        k = bisect_right(self.starts, at) - 1
        low, high, literal = self.sources[k]
        return (low + at - self.starts[k], low + at - self.starts[k] + 1) if literal else (low, high)


def _substituted(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer's text with each (start, end, replacement) done."""
    out, starts, sources, at, size = [], [], [], 0, 0
    for start, end, new in pieces:
        for text, source in ((layer.text[at:start], (at, start, True)), (new, (start, end, False))):
            if text:
                out.append(text)
                starts.append(size)
                sources.append(source)
                size += len(text)
        at = end
    if at < len(layer.text):
        out.append(layer.text[at:])
        starts.append(size)
        sources.append((at, len(layer.text), True))
    return Layer("".join(out), starts, sources, layer)


def _percent(layer: Layer) -> Layer | None:
    """Runs of escapes are decoded as UTF-8 one character at a time; broken bytes become U+FFFD."""
    pieces: list[tuple[int, int, str]] = []
    for run in PERCENTS.finditer(layer.text):
        escapes = list(PERCENT.finditer(run[0]))
        data = bytes.fromhex("".join(m[1] for m in escapes))
        at = 0
        while at < len(data):
            width = next((w for w in (1, 2, 3, 4) if _utf8(data[at : at + w]) is not None), 0)
            last = escapes[at + max(1, width) - 1]
            pieces.append((run.start() + escapes[at].start(), run.start() + last.end(), _utf8(data[at : at + width]) if width else "�"))
            at += max(1, width)
    return _substituted(layer, pieces) if pieces else None


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def _unicode(layer: Layer) -> Layer | None:
    pieces = []
    for m in UNICODE.finditer(layer.text):
        code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16)
        if code <= 0x10FFFF:
            pieces.append((m.start(), m.end(), chr(code)))
    return _substituted(layer, pieces) if pieces else None


def _inflate(data: bytes) -> tuple[bytes, int] | None:
    """What the gzip members or the zlib stream at the start of ``data`` hold, if of bounded size, and the bytes read."""
    out, size, at = [], 0, 0
    while data[at : at + 2] == b"\x1f\x8b" or not at and data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        try:
            stream = zlib.decompressobj(47)
            new = stream.decompress(memoryview(data)[at:], MAX_LAYER - size + 1)
        except zlib.error:
            break
        size += len(new)
        if size > MAX_LAYER:
            return None
        if not stream.eof:
            break
        out.append(new)
        at = len(data) - len(stream.unused_data)
    return (b"".join(out), at) if at else None


def _unpacked(data: bytes) -> tuple[bytes, int] | None:
    """``_inflate`` until what comes out is no stream any more; a stream that gives itself ends it."""
    first = found = _inflate(data)
    met: set[bytes] = set()
    while found is not None and (key := hashlib.blake2b(found[0], digest_size=16).digest()) not in met:
        met.add(key)
        first = found[0], first[1]
        found = _inflate(found[0])
    return first


def _printable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.95 * len(text)


def _stretches(data: bytes) -> Iterator[tuple[int, str]]:
    """Start and text of each stretch of printable UTF-8 of at least ``LEAST`` bytes."""
    at, held, size = 0, [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        width = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        if c.isprintable() or c in "\r\n\t":
            held.append(c)
            size += width
        else:
            if size >= LEAST:
                yield at - size, "".join(held)
            held, size = [], 0
        at += width
    if size >= LEAST:
        yield at - size, "".join(held)


def _base64(layer: Layer) -> Iterator[Layer]:
    """A candidate that is text, or a stream, as a whole is one layer. In others each of the four places
    where base64 may begin is tried, so that what stands before or after it does not hide it; each stream
    and each stretch of text found is a layer."""
    for m in BASE64.finditer(layer.text):
        runs = list(LINE.finditer(layer.text, m.start(), m.end()))
        blob = "".join(r[0] for r in runs)
        if all(r[0].isalpha() and (r[0].islower() or r[0].istitle()) or HEX.fullmatch(r[0]) for r in runs):
            continue
        firsts, shifts, n = [], [], 0
        for r in runs:
            firsts.append(n)
            shifts.append(r.start() - n)
            n += len(r[0])

        def place(at: int) -> int:
            return m.end() if at >= n else at + shifts[bisect_right(firsts, at) - 1]  # noqa: B023

        def mapped(text: str, byte: int, skip: int) -> Layer:
            """The layer of ``text``, whose bytes begin at ``byte`` of those read from character ``skip``."""
            starts, sources = [], []
            for i, c in enumerate(text):
                width = len(c.encode())
                end = skip - (-(byte + width) * 4 // 3)
                starts.append(i)
                sources.append((place(skip + byte * 4 // 3), place(end - 1) + 1 if end < n else m.end(), False))  # noqa: B023
                byte += width
            return Layer(text, starts, sources, layer)

        symbols = blob.replace("-", "+").replace("_", "/")
        whole = _decoded(symbols)
        plain = _unpacked(whole) if len(blob) % 4 != 1 else None
        text = None if len(blob) % 4 == 1 else _utf8(whole if plain is None else plain[0])
        if text is not None and _printable(text):
            yield Layer(text, [0], [(m.start(), m.end(), False)], layer) if plain is not None else mapped(text, 0, 0)
            if plain is None or plain[1] == len(whole):
                continue
        for skip in range(4):
            data, end = _decoded(symbols[skip:]), 0
            for head in MAGIC.finditer(data):
                if head.start() % 3 == 0 and head.start() >= end and (inner := _unpacked(data[head.start() :])) is not None:
                    low, end = head.start(), head.start() + inner[1]
                    source = (place(skip + low * 4 // 3), place(min(n, skip - (-end * 4 // 3)) - 1) + 1, False)
                    for _, part in [(0, t)] if (t := _utf8(inner[0])) is not None and _printable(t) else _stretches(inner[0]):
                        yield Layer(part, [0], [source], layer)
            for byte, part in _stretches(data):
                yield mapped(part, byte, skip)


def _decoded(symbols: str) -> bytes:
    """Standard base64 without padding; a last character that gives no byte is left out."""
    symbols = symbols[: len(symbols) - (len(symbols) % 4 == 1)]
    return base64.b64decode(symbols + "=" * (-len(symbols) % 4))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those of decoded layers, both sorted by start and kind."""
    base = base_spans(text)
    spans = set(base)
    work, seen = [Layer(text, [0], [(0, len(text), True)], None)], set()
    while work:
        layer = work.pop()
        if layer.parent is not None:
            for start, kind, end in base_spans(layer.text):
                low, high = layer.to_root(start, end)
                spans.add((low, kind, high))
        found = [_percent(layer)] if PERCENT.search(layer.text) else []
        if "\\" in layer.text or "&#" in layer.text:
            found.append(_unicode(layer))
        found += _base64(layer)
        for new in found:
            if new is not None and new.text != text:
                key = (hashlib.blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), new.to_root(0, len(new.text)))
                if key not in seen:
                    seen.add(key)
                    work.append(new)
        layer.text = ""  # the layers below it only need its pieces
    return base, sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, base spans and all spans as arrays of (kind, start, end)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [scan(t or "") for t in pdf["text"]]
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "base": [named(b) for b, _ in found], "spans": [named(a) for _, a in found]})

    span = "array<struct<kind: string, start: long, end: long>>"
    return map_chunks(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), run, f"doc_id long, base {span}, spans {span}")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = "cast(size(filter(base, x -> x.kind = '{0}')) as long) n_{0}"
    text = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return found.selectExpr("doc_id", *[count.format(k) for k in KINDS], f"sha2({text.format('base')}, 256) base_sha256", f"{text.format('spans')} spans")
