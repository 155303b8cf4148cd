"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is null or not among ``keys`` (one column, materialised). Only rows that may be among them are joined."""
    flagged = marked(df, column, keys)
    some = flagged.where("_marked").join(keys.select(F.col(keys.columns[0]).alias("_key")).distinct(), F.col(column) == F.col("_key"), "left_anti")
    return flagged.where("not _marked").unionByName(some).select(*df.columns)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts, and of numbers, in an Arrow batch: the JVM and the Python worker each hold one or two batches a task.
TEXTS, NUMBERS = 1000, 10_000


@contextmanager
def _tidied(spark: SparkSession, rows: int = NUMBERS) -> Iterator[None]:
    """What is materialised in here leaves no shuffle files behind: nobody reads them again, and the disk holds those of one step at a time. ``rows`` go to Python at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    wanted = {name: "true", ARROW_ROWS: str(rows)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, rows: int = NUMBERS) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage. ``rows`` go to Python at once."""
    _shared_folder(df.sparkSession)
    with _tidied(df.sparkSession, rows):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, rows: int = NUMBERS) -> DataFrame:
    """``cut`` as a Parquet table in the same folder: smaller, and read by column. Most columns are hashes, so no dictionaries are tried. ``rows`` go to Python at once."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    with _tidied(df.sparkSession, rows):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the filter of ``marked``: its table has at most a 64th as many rows of two longs, 8 MB.
MARKS = 1 << 25


def marked(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``_marked``: false only where ``column`` is none of the values of ``keys`` (one column), or null.

    The keys are folded into a bitmap of ``MARKS`` bits, which is broadcast, so the filter never
    grows with the data. With many more keys than bits it lets most rows pass, and the join that
    follows it has more to do.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    bit = lambda x: F.expr(f"shiftleft(1L, cast({x} % 64 as int))")
    masks = keys.select(slot(keys.columns[0]).alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(F.bit_or(bit("_slot")).alias("_mask"))
    joined = df.withColumn("_slot", slot(column)).withColumn("_at", F.expr("_slot div 64")).join(F.broadcast(masks), F.col("_at") == F.col("_word"), "left")
    return joined.select(*df.columns, (F.col(column).isNotNull() & F.coalesce(F.col("_mask").bitwiseAND(bit("_slot")) != 0, F.lit(False))).alias("_marked"))


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on and would keep the most that any task has held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def _cuts(batch: pa.RecordBatch, rows: int, size: int) -> list[int]:
    """Where to cut a batch so that a part has at most ``rows`` rows and, but for a single row, about ``size`` bytes of text."""
    texts = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    each = np.sum(texts, axis=0) if texts else np.zeros(batch.num_rows)
    cuts, held = [0], 0
    for i, n in enumerate(each.tolist()):
        if i > cuts[-1] and (i - cuts[-1] >= rows or held + n > size):
            cuts.append(i)
            held = 0
        held += n
    return [*cuts, batch.num_rows]


def map_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | pa.RecordBatch], ddl: str, rows: int = 128, size: int = 1 << 20) -> DataFrame:
    """``df`` through ``fn`` in runs of a few rows, so that a worker never holds a whole Arrow batch as Python strings."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    nullable = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in pairwise(_cuts(batch, rows, size)):
                if to > at:
                    out = fn(batch.slice(at, to - at).to_pandas(types_mapper=nullable))
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        give_back()

    return df.mapInArrow(run, schema)


def id_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if _tables.get("p") is None or len(_tables["p"]) < n:
        size = max(1 << 14, 1 << int(n - 1).bit_length())
        for name, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _tables[name] = np.multiply.accumulate(out)
    return _tables["p"], _tables["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space in UTF-8 bytes."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 bytes, and the words' starts and ends."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    value = (total[ends] - total[starts]) * q[starts]
    return mix(value ^ mix((ends - starts).astype(np.uint64))), starts, ends


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(data)[:2]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, or of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out = mix(out + words[j : j + n] + np.uint64(j + 1))
    return out
