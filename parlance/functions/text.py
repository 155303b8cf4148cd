"""Column functions on text and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent function words of German and English, and German letters, for the language vote.
GERMAN = """und ist nicht ich auch sind oder aber wenn weil dass haben hatte werden wird wurde kann können muss müssen soll jetzt
hier sehr mehr schon noch eine einen einem eines für über unter durch gegen ohne zwischen während vielleicht genau natürlich
eigentlich wirklich""".split()
ENGLISH = """the and is are were this that these those with from have has had would could should there their about because which what
when where your they them our been being just really actually maybe something anything""".split()
GERMAN_LETTERS, LETTER_WEIGHT, LEAST_VOTES = "äöüß", 3, 3


def letters(text: Column) -> Column:
    """The runs of letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def language_vote(text: Column) -> Column:
    """de or en by weighted votes of function words and German letters; null for a tie or fewer than three votes."""
    low = F.lower(text)
    special = F.char_length(low) - F.char_length(F.translate(low, GERMAN_LETTERS, ""))
    german = F.size(F.filter(letters(text), lambda w: w.isin(GERMAN))) + LETTER_WEIGHT * special
    english = F.size(F.filter(letters(text), lambda w: w.isin(ENGLISH)))
    return F.when((german + english >= LEAST_VOTES) & (german > english), "de").when((german + english >= LEAST_VOTES) & (english > german), "en")


def plain_words(text: Column) -> Column:
    """Lower-cased words; every other character than letters, digits, marks and _ parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}_]+", " "), " "), lambda w: w != "")


def subtitle_time(us: Column, mark: str) -> Column:
    """HH:MM:SS and milliseconds rounded half to even; negatives count as 0."""
    ms = F.bround(F.greatest(us, F.lit(0)) / 1000.0).cast("long")
    part = lambda size, width, rest=None: F.lpad(F.floor((ms if rest is None else ms % rest) / size).cast("string"), width, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 2, 3_600_000), F.lit(":"), part(1000, 2, 60_000), F.lit(mark), part(1, 3, 1000))


def clock(us: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; fractions are cut."""
    s = F.floor(us / 1_000_000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    short = F.concat((F.floor(s / 60) % 60).cast("string"), F.lit(":"), two(s % 60))
    long = F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, long).otherwise(short)


def escape_vtt(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def punctuation_parts(token: Column) -> Column:
    """lead, core and trail of a token: what stands before, between and after its first and last letter or digit."""
    part = lambda i: F.regexp_extract(token, r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", i)
    return F.struct(part(1).alias("lead"), part(2).alias("core"), part(3).alias("trail"))


def surface_forms(term: Column) -> Column:
    """A term, and with a capital if it is in lower case."""
    return F.when(F.lower(term) == term, F.array_distinct(F.array(term, F.concat(F.upper(F.substring(term, 1, 1)), F.substring(term, 2, 1 << 20))))).otherwise(F.array(term))


def name_forms(name: Column) -> Column:
    """A full name and its parts, each once."""
    return F.array_union(F.array(name), F.filter(F.split(name, r"\s+"), lambda p: p != ""))


def slug(title: Column, most: int = 80) -> Column:
    """A file name: forbidden characters to spaces, runs of spaces to one, at most ``most`` characters, never empty."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\x00-\x1f]', " "), r"\s+", " "))
    cut = F.trim(F.substring(clean, 1, most))
    return F.when(cut == "", "Meeting").otherwise(cut)


def without_reasoning(text: Column) -> Column:
    """The text without closed think blocks and without what follows an unclosed one."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*", ""))


def meeting_time(folder: Column) -> Column:
    """The time in a folder name meeting-YYYYMMDD-HHMMSS, or null."""
    found = F.concat(F.regexp_extract(folder, r"meeting-(\d{8})-(\d{6})", 1), F.regexp_extract(folder, r"meeting-(\d{8})-(\d{6})", 2))
    return F.try_to_timestamp(F.when(found != "", found), F.lit("yyyyMMddHHmmss"))


def decibels(energy: Column) -> Column:
    return 10 * F.log10(energy + 1e-12)


def token_score(depth: Column, first: float = 1.0, factor: float = 2.0) -> Column:
    """Reward of a boosting-tree node: ``first`` at depth 1, then first * factor + ln(depth)."""
    return F.when(depth <= 1, F.lit(first)).otherwise(first * factor + F.log(depth))


def wrap(text: Column, width: int = 42) -> Column:
    """Greedy lines of at most ``width`` characters, joined by line feeds; a longer word stands alone."""
    one_line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.rtrim(F.regexp_replace(one_line, rf"(\S{{{width + 1},}}|(?s:.){{1,{width}}})( |$)", "$1\n"), F.lit("\n"))
