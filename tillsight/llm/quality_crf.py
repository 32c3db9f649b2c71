"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line gets features of its own bytes and words and of the lines before
and after it.  The field is trained on labelled documents, each line with its
document's label; forward-backward gives every line's probability of being
good, and their mean, weighted by line length, is the document's quality.  A
logistic calibration on the training documents sets the 0.5 threshold.

Defined results: a NULL or empty text has one empty line and is scored as
such; without labelled rows of both kinds every score is 0.5; rows that
repeat a ``doc_id`` are scored one by one (one of them may train); very long
texts are scored whole; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import documents, rows_of, word_hashes, words
from .labelled import logistic, probability, remainder, sample

#: The classifier is fitted on at most this many labelled documents.
SAMPLE = 4_000
#: and on at most so many lines of each (every line of every text is scored).
SAMPLE_LINES = 2_000

_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, [ord(c) for c in "#*$%&|<>"]] = True
_CLASSES[1, 65:91] = True
_CLASSES[2, 97:123] = True
_CLASSES[3, 48:58] = True
_CLASSES[4, [ord(c) for c in ".,;:"]] = True
_CLASSES[5, [ord(c) for c in "!?"]] = True
_CLASSES[6, 128:] = True
_CLASSES[7, [32, 9, 11, 12, 13]] = True
_KIND = np.full(256, 8, np.uint8)
for _i, _row in enumerate(_CLASSES):
    _KIND[_row] = _i
FEATURES = 16


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines of a block of texts, and each text's first line."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # Lines end at line breaks and at text ends; a text of k breaks has k + 1 lines.
    lines_of = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(lines_of)])
    ends = np.empty(first[-1], np.int64)
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    ends[last], ends[~last] = offsets[1:], breaks
    begins = np.empty_like(ends)
    begins[first[:-1]] = offsets[:-1]
    begins[~_at(first[:-1], len(ends))] = breaks + 1
    size = ends - begins
    kinds = _KIND[data]
    counts = np.zeros((8, len(ends)))
    for k in range(8):
        at = np.flatnonzero(kinds == k)
        counts[k] = np.searchsorted(at, ends) - np.searchsorted(at, begins)
    starts, word_ends, _ = words(data, offsets)
    h = word_hashes(data, starts, word_ends)
    again = np.zeros(len(h) + 1, np.int64)
    if len(h):
        np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]), out=again[1:])
    w0, w1 = np.searchsorted(starts, begins), np.searchsorted(starts, ends)
    n_words = w1 - w0
    repeats = np.maximum(0, again[w1] - again[np.minimum(w0 + 1, len(again) - 1)]) * (n_words > 1)
    # A line equal (by its words) to the one before, or two before, in the same text.
    total = np.zeros(len(h) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(h, out=total[1:])
        key = total[w1] - total[w0]
    doc = np.repeat(np.arange(n_docs), lines_of)
    seen = np.lexsort((np.arange(len(key)), key, doc))
    duplicate = np.zeros(len(key))
    if len(key) > 1:
        same = (key[seen][1:] == key[seen][:-1]) & (doc[seen][1:] == doc[seen][:-1]) & (n_words[seen][1:] > 0)
        duplicate[seen[1:][same]] = 1
    text = np.maximum(1, size - counts[7])
    letters = np.maximum(1, counts[1] + counts[2] + counts[6])
    per_word = np.maximum(1, n_words)
    x = np.column_stack([
        np.minimum(1, 4 * counts[0] / text), counts[0] > 0, counts[0] >= 0.5 * per_word,
        counts[1] / letters, counts[1] > 0.5 * letters,
        np.minimum(1, 4 * counts[3] / text), np.minimum(1, 4 * counts[4] / text), np.minimum(1, 4 * counts[5] / text), counts[5] >= 0.3 * per_word,
        repeats / per_word, repeats > 0.3 * per_word, duplicate,
        np.log1p(n_words) / 6, n_words == 0, np.minimum(1, text / per_word / 20), np.ones(len(ends)),
    ]).astype(float)
    return x, size, first


def _at(rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[rows] = True
    return out


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and the line after in its text (zero at the ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([x, before, after])


def document_scores(x: np.ndarray, size: np.ndarray, first: np.ndarray, model: crf.CRF) -> np.ndarray:
    """The length-weighted mean probability of good lines of every text."""
    p, _, _ = crf.marginals(model.emissions(x), first, model)
    weight = size + 1.0
    return np.add.reduceat(weight * p[:, 1], first[:-1]) / np.add.reduceat(weight, first[:-1])


def _logit(s: np.ndarray) -> np.ndarray:
    s = np.clip(s, 1e-6, 1 - 1e-6)
    return np.log(s / (1 - s))[:, None]


def fit(docs: DataFrame, labels: DataFrame, may_train, rows: int = SAMPLE):
    """The field and its calibration, from a bounded sample of training documents; None without both labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in rows_of(b):
                x, size, first = line_features(data, offsets)
                x, ends = x.astype(np.float32), np.minimum(first[1:], first[:-1] + SAMPLE_LINES)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, end - row), b.column(2).slice(row, end - row),
                     pa.array([x[i:j].tobytes() for i, j in zip(first[:-1], ends)], pa.binary()),
                     pa.array([size[i:j].tobytes() for i, j in zip(first[:-1], ends)], pa.binary())], ["doc_id", "label", "x", "size"])

    found = sample(docs, labels, "quality", may_train, rows).select("doc_id", "text", "label")
    found = sorted(found.mapInArrow(run, "doc_id long, label int, x binary, size binary").collect(), key=lambda r: (r.doc_id, r.x, r.label))
    y = np.array([r.label for r in found])
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in found]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    x = with_neighbours(np.concatenate(parts).astype(float), first)
    size = np.concatenate([np.frombuffer(r.size, np.int64) for r in found])
    model = crf.train(x, np.repeat(y, np.diff(first)), first, 2)
    return model, logistic(_logit(document_scores(x, size, first, model)), y)


def batch_scores(batch: pa.RecordBatch, fitted) -> np.ndarray:
    """The score of every text of an Arrow batch."""
    out = [np.zeros(0)]
    for _, _, data, offsets in rows_of(batch):
        x, size, first = line_features(data, offsets)
        out.append(probability(_logit(document_scores(with_neighbours(x, first), size, first, fitted[0])), fitted[1]))
    return np.concatenate(out)


def score(docs: DataFrame, fitted) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5) if fitted is None else batch_scores(b, fitted)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows whose id's crc32 leaves 1 modulo 3 never train."""
    out = score(docs, fit(docs, labels, remainder(3) != 1, rows))
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: one row per document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
