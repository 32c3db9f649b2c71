"""Shared helpers of the llm operators: scratch tables, Arrow text access, byte-level words and bounded caches.

Every operator works on a frame with a ``doc_id`` and a ``text`` column
(names are parameters), ignores other columns and reads a NULL text as the
empty text.
"""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


# ------------------------------------------------------------ scratch tables
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: an executor lost later costs a re-read, not a re-run.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, plus the named columns; nothing else is read."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


# ------------------------------------------------------------ worker memory
def release() -> None:
    """Give memory that this worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


_HELD: dict = {}


def held(key, make):
    """This worker's object for ``key``, made once.

    A worker outlives its tasks and serves one operator after the other: an
    object of another key, with its caches, is let go first, so that a worker
    holds one operator's model at a time.
    """
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
    return _HELD[key]


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Whole texts go to the workers in Arrow batches of at most ``most`` bytes (a longer text alone); a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name, f"{1 << 30}b").strip().lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > most:
        spark.conf.set(name, str(most))


# -------------------------------------------------------------- Arrow access
def rows_of(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` blocks of the batch's texts, about ``most`` bytes each.

    A text longer than ``most`` is a block of its own; NULL is empty.
    """
    column = batch.column(batch.schema.get_field_index("text"))
    column = pc.fill_null(column.cast(pa.large_utf8()), "")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The batch's texts as Python strings, NULL as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index("text")), "").to_pylist()


# --------------------------------------------------------- byte-level words
def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` well mixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _splitmix(256, 7) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_POWERS = np.ones(1 << 12, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    with np.errstate(over="ignore"):
        while len(_POWERS) < n:
            _POWERS = np.concatenate([_POWERS, _POWERS * (_POWERS[-1] * _BASE)])
        if _POWERS[1] == 1:  # first use
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(_POWERS) - 1, _BASE)]), dtype=np.uint64)
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block of texts: ``(starts, ends, first word of each text)``.

    Separators are single ASCII bytes, so words of UTF-8 bytes are words of
    characters.  No word crosses from one text into the next.
    """
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first: a polynomial over random byte values, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        power, step = _powers(int(lengths.max()) + 1), 1 << 17
        for i in range(0, len(starts), step):
            n = lengths[i:i + step]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = np.arange(int(n.sum())) - np.repeat(first, n)
            byte = data[at + np.repeat(starts[i:i + step], n)]
            out[i:i + step] = np.add.reduceat(_BYTE[_LOWER[byte] if lower else byte] * power[at], first)
        return mix(out ^ (lengths.astype(np.uint64) << np.uint64(48)))


# ------------------------------------------------------------ bounded caches
class Cache(dict):
    """A mapping of at most ``2 * room`` entries: a full generation becomes the old one, used entries come back."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.old = room, {}

    def turn(self) -> None:
        """Start a new generation if this one is full; call it between texts."""
        if len(self) > self.room:
            self.old = dict(self)
            self.clear()

    def absent(self, keys: set) -> list:
        """The keys that have no value yet; those of the old generation are brought back."""
        lacking = [k for k in keys if k not in self]
        if not self.old:
            return lacking
        out = []
        for k in lacking:
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out
