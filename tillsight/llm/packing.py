"""Packing documents into training sequences by non-negative least squares.

1. Every document (its ids and an end id) is cut at multiples of the window:
   full windows are sequences of their own, a remainder shorter than the
   window is left.  Only lengths and checksums of pieces are kept.
2. The histogram of remainders (at most ``window - 1`` bins, whatever the
   corpus) goes to the driver.  Combinations of up to three lengths that fill
   the window exactly are enumerated over the lengths that occur; repeat
   counts solve ``min |A x - h|`` with ``x >= 0`` and are rounded down.
3. What is left of the histogram is packed greedily, longest first, each
   window closed by the longest lengths that still fit.
4. The plan is a table of (length, ranks) -> (sequence, offset) intervals.
   Remainders are numbered within their length, by partition totals and the
   position in the partition, and look their place up.

No step gathers a length's documents in one task: numbers come from the
task that cut the document, shifted by the totals of earlier partitions.

Defined results: a NULL or empty text is one piece of one id; repeated rows
are packed as often as they stand there; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import word_bpe
from .common import documents, stored

WINDOW = 2048
_ROUNDS = 400


# ------------------------------------------------------------- pieces of texts
def cut(df: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per document: its piece checksums, its task and its numbers among that task's rows.

    ``rank``: earlier remainders of the same length in the task; ``full_before``:
    earlier full windows in the task.
    """
    schema = "doc_id long, doc_tokens long, crcs array<long>, part int, rest int, rank long, full_before long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, part = word_bpe.encoder(path), TaskContext.get().partitionId()
        seen, before = np.zeros(window, np.int64), 0
        for b in batches:
            for row, ids, offsets in bpe.blocks(b.column(1), word_bpe.END):
                n = np.diff(offsets)
                rest, full = n % window, n // window
                # Earlier rows of the same remainder: those of the block by a stable sort, those before it by their count.
                order = np.argsort(rest, kind="stable")
                first = np.searchsorted(rest[order], rest[order], "left")
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - first
                rank += seen[rest]
                seen += np.bincount(rest, minlength=window)
                crcs = [[zlib.crc32(ids[i:min(i + window, end)]) for i in range(begin, end, window)]
                        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, len(n)), pa.array(n), pa.array(crcs, pa.list_(pa.int64())), pa.array(np.full(len(n), part, np.int32)),
                     pa.array(rest.astype(np.int32)), pa.array(rank), pa.array(before + np.cumsum(full) - full)],
                    ["doc_id", "doc_tokens", "crcs", "part", "rest", "rank", "full_before"])
                before += int(full.sum())

    return documents(df).mapInArrow(run, schema)


# ---------------------------------------------------------------- the pack plan
def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) from ``lengths`` that fill the window exactly, in descending order."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = window - a - b
    ok = (a >= b) & (c >= 0) & (c <= b)
    ok[ok] &= have[c[ok]] | (c[ok] == 0)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def non_negative(combos: np.ndarray, histogram: np.ndarray, rounds: int = _ROUNDS) -> np.ndarray:
    """Repeat counts ``x >= 0`` that bring each length's use near its count: accelerated projected gradients.

    The bin 0 (no third length) has no weight.  The step is one over a bound
    of the matrix's squared norm (its largest row sum times column sum).
    """
    h = histogram.astype(float)
    n = len(h)
    def times(x):
        out = sum(np.bincount(combos[:, k], x, n) for k in range(3))
        out[0] = 0
        return out
    step = 1.0 / (3 * max(1.0, times(np.ones(len(combos))).max()))
    x = z = np.zeros(len(combos))
    t = 1.0
    # Rows of rare lengths get as much say as those of frequent ones.
    weight = np.where(h > 0, 1.0, 0.0)
    for _ in range(rounds):
        r = weight * (times(z) - h)
        new = np.maximum(0.0, z - step * (r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]))
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / later * (new - x), new, later
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, tuple[int, ...]]]:
    """``(repeats, lengths)`` patterns that use every remainder of the histogram once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    patterns = []

    def use(lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            patterns.append((int(times), lengths))
            for n in lengths:
                left[n] -= times

    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        x = non_negative(combos, left)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            lengths = tuple(int(v) for v in combos[i] if v)
            most = min(left[n] // lengths.count(n) for n in set(lengths))
            use(lengths, min(int(x[i] + 0.5), most))
    while left.any():  # residuals: longest first, closed by the longest that fit
        lengths, room = [], window
        while room > 0:
            free = left[:room + 1].copy()
            for n in lengths:
                if n <= room:
                    free[n] -= 1
            fit = np.flatnonzero(free)
            if not len(fit):
                break
            best = int(fit[-1])
            for k in fit[::-1][:64]:  # a pair that closes the window exactly, if one is near
                other = room - int(k)
                if other == 0 or (0 < other <= room and free[other] > (other == k)):
                    best = int(k)
                    break
            lengths.append(best)
            room -= best
        use(tuple(lengths), min(left[n] // lengths.count(n) for n in set(lengths)))
    return patterns


def places(patterns: list[tuple[int, tuple[int, ...]]], window: int, first_sequence: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset, slots), sorted by rank.

    Of a pattern's repeats each is a sequence.  A row covers the repeats of
    one slot: rank ``first + i`` lies in sequence ``first sequence + i``.
    """
    used, out, sequence = {}, {}, first_sequence
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return {n: np.array(v, np.int64) for n, v in out.items()}


def pack(df: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of every row: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    docs = stored(cut(df, path, window), "pack-cut")
    totals = docs.groupBy("part", "rest").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor((F.col("doc_tokens") - F.col("rest")) / window)).alias("full"))
    totals = stored(totals, "pack-totals")
    # Numbers of full windows by partition; numbers of remainders by length and partition.
    full_base = totals.groupBy("part").agg(F.sum("full").alias("full")).withColumn(
        "full_base", F.sum("full").over(Window.orderBy("part")) - F.col("full")).select("part", "full_base")
    rank_base = totals.withColumn(
        "rank_base", F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")).select("part", "rest", "rank_base")
    histogram, n_full = np.zeros(window, np.int64), 0
    for r in totals.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect():  # at most `window` rows
        histogram[r.rest] += r.n
        n_full += r.full
    by_length = places(plan(histogram, window), window, n_full)
    docs = docs.join(rank_base, ["part", "rest"]).join(full_base, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {f: b.column(i) for i, f in enumerate(b.schema.names)}
            n, crcs = col["doc_tokens"].to_numpy(), col["crcs"].to_pylist()
            rest, rank, full = (col[k].to_numpy() for k in ("rest", "rank", "full"))
            pieces = [len(c) for c in crcs]
            doc = np.repeat(np.arange(len(n)), pieces)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(n[doc] - at * window, window)
            sequence, offset = full[doc] + at, np.zeros(len(doc), np.int64)
            short = np.flatnonzero(length < window)
            order = short[np.argsort(length[short], kind="stable")]
            lengths, first = np.unique(length[order], return_index=True)
            for m, rows in zip(lengths, np.split(order, first[1:])):
                table = by_length[int(m)]
                k = rank[doc[rows]]
                i = np.searchsorted(table[:, 0], k, "right") - 1
                sequence[rows] = table[i, 1] + k - table[i, 0]
                offset[rows] = table[i, 2]
            flat = [c for x in crcs for c in x]
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"].take(pa.array(doc)), pa.array(at * window), pa.array(length), pa.array(flat, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    docs = docs.select("doc_id", "doc_tokens", "crcs", "rest", (F.col("rank") + F.col("rank_base")).alias("rank"),
                       (F.col("full_before") + F.col("full_base")).cast("long").alias("full"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: one row per piece."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(word_bpe.VOCABULARY))
