"""Shared helpers of the corpus operators: reading tables, scratch space, text batches.

Every operator keeps its Spark work in DataFrames.  Python appears only inside
``mapInArrow`` tasks that stream Arrow batches, and these helpers keep what one
task holds bounded by a few megabytes of text.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step looks at (a longer text is one step).
STEP_BYTES = 1_000_000


def frees(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of a task, after which the Python worker gives the memory it no longer uses back.

    Workers outlive their tasks, and an executor pays for what they hold.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_unused()

    return wrapped


def free_unused() -> None:
    """Return the allocators' free memory to the system, where they can."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the session has no such setting and one machine is the cluster (tests), a
    local temporary folder is set as the checkpoint folder and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tilewright-"))
            current = spark.sparkContext.getCheckpointDir()
        base = current
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, gone: DataFrame, text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose id and text hash are not in ``gone`` (gone_id, gone_hash).

    ``gone`` is broadcast up to ``most`` rows (16 bytes each), and shuffled beyond.
    Names are chosen so that they clash with none of ``docs``.
    """
    prefix = "gone"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    gone = saved(gone.select(F.col("gone_id").alias(f"{prefix}id"), F.col("gone_hash").alias(f"{prefix}hash")).distinct(), "gone")
    if gone.count() <= most:
        gone = F.broadcast(gone)
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{prefix}id")) & (text == F.col(f"{prefix}hash")), "left_anti")


def text_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text columns alone, a null text as an empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """Cut Arrow batches of (doc_id, text, ...) into runs of about ``limit`` bytes.

    Yields the ids as an Arrow array and the texts as Python strings.
    """
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        n = len(texts)
        if not n:
            continue
        sizes = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield ids.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to


def with_text_columns(docs: DataFrame, of: Callable[[list[str]], list[pa.Array]], fields: str, text_col: str = "text") -> DataFrame:
    """``docs`` with columns computed from each text (a null one as an empty one).

    Rows pass through in their Arrow batches, and leave in pieces of about
    ``STEP_BYTES`` of text; neither side queues rows.
    """
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(fields).fields])
    names = schema.names

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, begin = pc.fill_null(batch.column(at).cast(pa.string()), ""), 0
            for _, texts in text_steps(iter([pa.RecordBatch.from_arrays([text, text], names=["id", "text"])])):
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, *of(texts)], names=names)
                begin += len(texts)

    return docs.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word (wraps modulo 2**64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd base of the prefix polynomial modulo 2**64 and its inverse.
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    known = _POWERS.get(kind)
    if known is None or len(known) < n:
        size = 1 << max(16, int(n).bit_length())
        step = np.full(size, np.uint64(_BASE if kind == "up" else _INV), dtype=np.uint64)
        step[0] = 1
        known = np.multiply.accumulate(step)
        _POWERS[kind] = known
    return known


def _word_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    gap = np.zeros(256, dtype=bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return lower, gap, value


_LOWER, _GAP, _VALUE = _word_table()


def words_of(text: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text: 64-bit hashes, starts and ends in bytes.

    With ``lower`` the letters A-Z count as a-z.  A word's hash is its
    polynomial modulo 2**64, read off prefix sums, then mixed; no Python code
    runs per word.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    inside = ~_GAP[raw]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    return range_hashes(_LOWER[raw] if lower else raw, starts, ends), starts, ends


def range_hashes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each range, which does not depend on where it lies."""
    n = len(code)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[code] * _powers("up", n)[:n], out=total[1:])
    hashed = (total[ends] - total[starts]) * _powers("down", n + 1)[starts]
    return mix64(hashed + (ends - starts).astype(np.uint64))
