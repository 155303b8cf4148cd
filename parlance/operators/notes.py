"""Structure of Markdown notes: headings, sections, checks against a template, prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content, fenced): fenced lines lie inside a code fence or open or close one."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    fence = F.col("content").rlike(r"^\s*(```|~~~)")
    order = W.partitionBy(key).orderBy("line")
    before = F.coalesce(F.sum(fence.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("fenced", fence | (before % 2 == 1))


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, title) of headings outside code fences."""
    rows = lines_of(docs, key, text).where(~F.col("fenced") & F.col("content").rlike(r"^#{1,6}\s+\S"))
    return rows.select(key, "line", F.length(F.regexp_extract("content", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("content", r"^#+\s+(.*)$", 1)).alias("title"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, title, n_lines): lines with content under each heading, 0 before the first."""
    rows = lines_of(docs, key, text)
    is_heading = ~F.col("fenced") & F.col("content").rlike(r"^#{1,6}\s+\S")
    order = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = rows.withColumn("_h", is_heading).withColumn("section", F.sum(F.col("_h").cast("int")).over(order))
    title = F.max(F.when(F.col("_h"), F.trim(F.regexp_extract("content", r"^#+\s+(.*)$", 1))))
    return numbered.groupBy(key, "section").agg(title.alias("title"), F.count_if(~F.col("_h") & (F.trim("content") != "")).alias("n_lines"))


def missing_sections(docs: DataFrame, key: str, text: str, template: list[str]) -> DataFrame:
    """(key, warnings): template headings that a document lacks, in the template's order."""
    found = headings(docs, key, text).groupBy(key).agg(F.collect_set(F.lower("title")).alias("have"))
    wanted = F.array(*[F.lit(t) for t in template])
    have = F.coalesce("have", F.array().cast("array<string>"))
    return docs.select(key).join(found, key, "left").select(key, F.filter(wanted, lambda t: ~F.array_contains(have, F.lower(t))).alias("warnings"))


def prompt(title: Column, language: Column, names: Column, body: Column) -> Column:
    """Context lines that are known, then the transcript."""
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", line("Title", title), line("Language", language), line("Attendees", F.array_join(names, ", ")), F.lit("Transcript:"), body)


def without_thoughts(text: str) -> str:
    """The text without its think blocks; one that is never closed runs to the end."""
    kept, rest = "", text
    while rest:
        before, opened, rest = rest.partition("<think>")
        kept += before
        if opened:
            rest = rest.partition("</think>")[2]
    return kept


def heading_text(line: str) -> str | None:
    """The text of a first-level heading, without the marks that may close it; null for other lines."""
    if not line.startswith("#") or not line[1:2].isspace():
        return None
    return line[1:].strip().rstrip("#").strip() or None


def is_fence(line: str) -> bool:
    return line.lstrip()[:3] in ("```", "~~~")


def unwrapped(text: str) -> tuple[str | None, str]:
    """Title (of the first first-level heading, or null) and body of the note inside a response.

    Think blocks go. The note starts at the first such heading outside code fences. Where there is
    none, it is what the first fenced block with such a heading holds (to the end, if its fence never closes), or
    else the whole response. A bare fence at the end that opens nothing goes too.
    """
    lines = without_thoughts(text).splitlines()
    opened, titled = None, False  # the line that opened the current block, and whether the block has a heading
    outside = block = None
    for i, line in enumerate(lines):
        if is_fence(line):
            if opened is None:
                opened, titled = i, False
            else:
                block = block or ((opened + 1, i) if titled else None)
                opened = None
        elif heading_text(line):
            if opened is not None:
                titled = True
            elif outside is None:
                outside = i
    if opened is not None and titled:
        block = block or (opened + 1, len(lines))
    if opened is not None and not "".join(lines[opened:]).strip().strip("`~"):
        lines = lines[:opened]
    if outside is not None:
        lines = lines[outside:]
    elif block:
        lines = lines[slice(*block)]
    body = "\n".join(lines).rstrip().lstrip("\n")
    first, _, rest = body.lstrip().partition("\n")
    title = heading_text(first.strip())
    return (title, rest.strip("\n")) if title else (None, body)


_NOTE = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])


@F.pandas_udf(_NOTE)
def unwrap(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unwrapped(t or "") for t in text], columns=["title", "body"])
