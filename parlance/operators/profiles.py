"""Meeting profiles, names of speakers, and what clusters of a channel are named."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import depth, merge_gaps, subtract

MOST_SPEAKERS = 8
EMBED_US = 500_000


def planned_channels(meetings: DataFrame) -> DataFrame:
    """(meeting, channel, speakers, plan) from (meeting, local, remote): a count of 0 leaves a channel out, null is estimated, 1 needs no diarization.

    A count outside 0 to 8, or two counts of 0, fail.
    """
    wrong = lambda c: ~F.coalesce(F.col(c).between(0, MOST_SPEAKERS), F.lit(True))
    nobody = F.coalesce((F.col("local") == 0) & (F.col("remote") == 0), F.lit(False))
    local = F.when(wrong("local") | wrong("remote"), F.raise_error(F.lit("a speaker count is not between 0 and 8")).cast("int"))
    local = local.when(nobody, F.raise_error(F.lit("a meeting needs a speaker")).cast("int")).otherwise(F.col("local"))
    each = F.array(F.struct(F.lit("mic").alias("channel"), local.alias("speakers")), F.struct(F.lit("system").alias("channel"), F.col("remote").alias("speakers")))
    rows = meetings.select("meeting", F.explode(each).alias("c")).select("meeting", "c.*").where("speakers is null or speakers <> 0")
    return rows.withColumn("plan", F.when(F.col("speakers").isNull(), "estimate").when(F.col("speakers") == 1, "single").otherwise("diarize"))


def diarizes(local: Column, remote: Column, switch: Column) -> Column:
    """The switch if it is set, else whether any count is unknown or above one."""
    many = lambda c: c.isNull() | (c > 1)
    return F.coalesce(switch, many(local) | many(remote))


def mode(local: Column, remote: Column) -> Column:
    """What the counts say of a meeting; null where they do not."""
    known = local.isNotNull() & remote.isNotNull()
    return F.when(remote == 0, "in_room").when(known & (local <= 1), "online").when(known, "hybrid")


def named(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Entries whose ``speaker`` is replaced by its ``name`` in (speaker, name), where it has one."""
    known = names.select(F.col("speaker").alias("_s"), F.col("name").alias("_n"))
    return entries.join(known, entries["speaker"] == known["_s"], "left").withColumn("speaker", F.coalesce("_n", "speaker")).drop("_s", "_n")


def short_label(label: Column) -> Column:
    """SPEAKER_07 as S7; other labels stay."""
    return F.when(label.rlike("^SPEAKER_[0-9]+$"), F.concat(F.lit("S"), F.substring(label, 9, 1 << 20).cast("long").cast("string"))).otherwise(label)


def recased(token: Column, core: Column, term: Column) -> Column:
    """A term's token in the case that it may have: a term in lower case keeps the capital of what it replaces."""
    plain = (F.lower(term) == term) & (F.upper(F.substring(core, 1, 1)) == F.substring(core, 1, 1)) & (F.lower(F.substring(core, 1, 1)) != F.substring(core, 1, 1))
    return F.when(plain, F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, 2, 1 << 20))).otherwise(token)


def assigned(scored: DataFrame, key: Sequence[str], threshold: float) -> DataFrame:
    """(*key, label, profile, score): within each key the best score first, each label and profile at most once, none below the threshold.

    On equal scores the greater label, then the greater profile, comes first. A key holds the few
    clusters and profiles of one channel.
    """
    kept = scored.where(F.col("score") >= threshold).select(*key, "label", "profile", "score")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, profiles, out = set(), set(), []
        for i in pdf.sort_values(["score", "label", "profile"], ascending=False).index:
            if pdf.at[i, "label"] not in labels and pdf.at[i, "profile"] not in profiles:
                labels.add(pdf.at[i, "label"])
                profiles.add(pdf.at[i, "profile"])
                out.append(i)
        return pdf.loc[out]

    return kept.groupBy(*key).applyInPandas(run, kept.schema)


def self_merged(clusters: DataFrame, threshold: float) -> DataFrame:
    """(channel, label, into): clusters of a channel joined along pairs of at least the threshold's cosine, under their least label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        labels, vectors = pdf["label"].tolist(), [list(v) for v in pdf["v"]]
        into = {x: x for x in labels}
        for i, a in enumerate(labels):
            for j in range(i + 1, len(labels)):
                if sum(p * q for p, q in zip(vectors[i], vectors[j])) >= threshold:
                    low, high = sorted((into[a], into[labels[j]]))
                    into = {x: low if y == high else y for x, y in into.items()}
        return pd.DataFrame({"channel": pdf["channel"], "label": labels, "into": [into[x] for x in labels]})

    return clusters.select("channel", "label", "v").groupBy("channel").applyInPandas(run, "channel long, label string, into string")


def embedding_spans(turns: DataFrame) -> DataFrame:
    """(channel, speaker, start_us, end_us): what of a speaker's speech its voice is learned from.

    Speech outside overlaps, or all of it where nothing else is left; of that, spans of half a
    second or more, or all where none is that long.
    """
    key = ["channel", "speaker"]
    own = merge_gaps(turns.select(*key, "start_us", "end_us"), key, "start_us", "end_us", 0)
    cuts = depth(own, ["channel"], "start_us", "end_us").where("depth >= 2").select("channel", "start_us", "end_us")
    clean = subtract(own, cuts.join(own.select(*key).distinct(), "channel"), key, "start_us", "end_us")
    spans = clean.unionByName(own.join(clean.select(*key).distinct(), key, "left_anti"))
    long = F.col("end_us") - F.col("start_us") >= EMBED_US
    some = spans.where(long).select(*key).distinct()
    return spans.where(long).unionByName(spans.join(some, key, "left_anti")).select(*key, "start_us", "end_us")


def note(title: Column, created: Column, language: Column, body: Column, transcript: Column) -> Column:
    """A note with YAML front matter, its body, and the transcript's lines (an array) as a folded quotation."""
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit("'")), F.lit('"')), F.concat(F.lit("date: "), F.date_format(created, "yyyy-MM-dd")),
        F.concat(F.lit("created: "), F.date_format(created, "yyyy-MM-dd'T'HH:mm")), F.lit("type: meeting"), F.concat(F.lit("language: "), language), F.lit("tags: [meeting]"), F.lit("---"),
    )
    quoted = F.array_join(F.transform(transcript, lambda x: F.concat(F.lit("> "), x)), "\n>\n")
    parts = [front, F.lit(""), F.concat(F.lit("# "), title), F.lit(""), F.regexp_replace(body, r"\s+$", ""), F.lit(""), F.lit("> [!quote]- Transcript")]
    return F.concat(F.concat_ws("\n", *parts, F.when(F.size(transcript) > 0, quoted)), F.lit("\n"))
