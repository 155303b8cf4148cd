"""Sampled signals: lag between two of them, reference windows by time, energy lost to an echo canceller."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a tick, and of the stretch that is compared (8 s at 16 kHz).
TICK, STRETCH = 160, 128_000


def loudest(far: np.ndarray, stretch: int, tick: int) -> int:
    """The first sample of the stretch, beginning at a tick, in which the mean level of the ticks is highest."""
    level = np.sqrt((far[: len(far) // tick * tick].reshape(-1, tick) ** 2).mean(axis=1))
    total = np.concatenate([[0.0], np.cumsum(level)])
    ticks = max(1, stretch // tick)
    return int(np.argmax(np.round(total[ticks:] - total[:-ticks], 6))) * tick


def lag_of(near: np.ndarray, far: np.ndarray, span: int, stretch: int = STRETCH, tick: int = TICK) -> tuple[int, float]:
    """By how many samples ``near`` trails ``far``, at most ``span`` either way, and the product of both there, over the loudest stretch of ``far``.

    All lags are compared at once by a product of Fourier transforms, so the work grows with n log n.
    """
    if len(far) > stretch:
        at = loudest(far, stretch, tick)
        near, far = near[at : at + stretch], far[at : at + stretch]
    near, far = near - near.mean(), far - far.mean()
    size = 1 << (len(near) + len(far)).bit_length()
    product = np.fft.irfft(np.fft.rfft(near, size) * np.conj(np.fft.rfft(far, size)), size)
    span = min(span, len(far) - 1)
    found = np.concatenate([product[size - span :], product[: span + 1]])
    best = int(np.argmax(np.round(np.abs(found), 6)))
    return best - span, float(found[best])


def sample_lag(samples: DataFrame, span: int, stretch: int = STRETCH, tick: int = TICK) -> DataFrame:
    """(stream, lag, product) of (stream, place, near, far); the least lag of equal ones. A stream is one recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        lag, product = lag_of(pdf["near"].to_numpy(), pdf["far"].to_numpy(), span, stretch, tick)
        return pd.DataFrame({"stream": [pdf["stream"].iloc[0]], "lag": [lag], "product": [product]})

    return samples.select("stream", "place", "near", "far").groupBy("stream").applyInPandas(run, "stream long, lag long, product double")


def reference_windows(track: DataFrame, asks: DataFrame) -> DataFrame:
    """(stream, ask, samples) for windows (stream, ask, place, count) of a track (stream, place, sample) without gaps.

    What lies before the track's first sample is silence, also for a window that lies there as a whole. Null means that
    the track has not come so far, or has not begun.
    """
    bounds = track.groupBy("stream").agg(F.min("place").alias("_first"), F.max("place").alias("_last"))
    known = asks.join(bounds, "stream", "left")
    end = F.col("place") + F.col("count")
    arrived = (end <= F.col("_first")) | (end - 1 <= F.col("_last"))
    known = known.withColumn("_arrived", F.coalesce(arrived, F.lit(False)))
    places = known.where("_arrived and count > 0").select("stream", "ask", F.explode(F.sequence(F.col("place"), end - 1)).alias("place"))
    heard = places.join(track.select("stream", "place", "sample"), ["stream", "place"], "left").withColumn("sample", F.coalesce("sample", F.lit(0)))
    made = heard.groupBy("stream", "ask").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sample"))), lambda x: x["sample"]).alias("samples"))
    empty = F.when(F.col("_arrived"), F.array().cast(made.schema["samples"].dataType))
    return known.select("stream", "ask", "_arrived").join(made, ["stream", "ask"], "left").select("stream", "ask", F.coalesce("samples", empty).alias("samples"))


def level_db(energy: Column) -> Column:
    """Decibels of a mean square; silence is at the floor of -100."""
    return F.greatest(F.lit(-100.0), 10 * F.log10(F.greatest(energy, F.lit(1e-10))))


def echo_loss(frames: DataFrame, tick: int = TICK, active_db: float = -40.0) -> DataFrame:
    """(stream, active, loss_db) of samples (stream, place, mic, out, far) in -1..1: by how much the canceller's output is quieter than its input over the ticks in which the far side is active."""
    square = lambda c: F.avg(F.col(c) * F.col(c))
    ticks = frames.groupBy("stream", F.floor(F.col("place") / tick).alias("tick")).agg(square("mic").alias("mic"), square("out").alias("out"), square("far").alias("far"))
    loud = ticks.where(level_db(F.col("far")) > active_db)
    return loud.groupBy("stream").agg(F.count(F.lit(1)).alias("active"), (level_db(F.avg("mic")) - level_db(F.avg("out"))).alias("loss_db"))
