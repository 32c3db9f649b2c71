"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word with its boundaries.  Its letters are spread to four
pseudo-random bytes each, so that a frame's length counts the phrases that a
dictionary lacks rather than header bytes.  A window that the toxic
dictionary compresses much better than the ordinary one speaks for toxicity;
a text's score comes from its most telling windows, by thresholds that a
logistic regression calibrates on the training documents.

The dictionaries are trained on a bounded sample of labelled documents:
the toxic one holds the words that toxic documents have significantly more
often, the ordinary one the frequent words of ordinary documents.  Cross-fitting
calibrates: every training document is judged by dictionaries of the other
folds, and how telling a word must be is what puts the fewest of them on the
wrong side.  The final dictionaries are of all sampled documents.

Defined results: NULL, empty and wordless texts have the score of a text
without any telling window; without labelled rows of both kinds every score
is 0; rows that repeat a ``doc_id`` are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, documents, held, mix, texts_of
from .labelled import logistic, probability, remainder, sample

#: Dictionaries and thresholds are fitted on at most this many labelled documents, of at most this many characters each.
SAMPLE, SAMPLE_CHARS = 10_000, 100_000
#: A word of the toxic dictionary: in so many toxic documents, by one of these likelihood ratios, as the calibration decides.
LEAST_DOCUMENTS, LEAST_RATIOS = 3, (24.0, 18.0, 12.5, 9.0)
FOLDS = 5
ORDINARY_WORDS, TOXIC_WORDS = 2_000, 4_000
#: Windows of which the toxic dictionary saves less than a fifth are not compared further.
SAVES = 0.8
#: Words whose lengths a worker remembers (twice as many at most, about 170 bytes each).
CACHED_WORDS = 60_000
#: Telling features of a text, and a window that says nothing.
FEATURES, _NOTHING = 5, (0, 0, 0)
_WORD = re.compile(r"[^\W\d_]+")
_CODE = [x.tobytes() for x in (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype("<u4")]
_LEVEL = dict(compression_level=16, min_match=4, strategy=zstandard.STRATEGY_BTOPT, hash_log=16, chain_log=16,
              search_log=5, window_log=18, write_content_size=False)


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def spread(words: str) -> bytes:
    return b"".join([_CODE[b] for b in words.encode()])


def _compressor(words: list[str]) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(spread(" " + " ".join(words) + " "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=zstandard.ZstdCompressionParameters(**_LEVEL))


class Distance:
    """Compression lengths of windows under both dictionaries."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.known = Cache(CACHED_WORDS)

    def window(self, word: str) -> tuple[int, int, int] | None:
        """Lengths under the toxic and the ordinary dictionary and as it is, if the toxic one saves anything to speak of."""
        x = spread(f" {word} ")
        n = len(self.toxic.compress(x))
        return (n, len(self.ordinary.compress(x)), len(x)) if n <= SAVES * len(x) else _NOTHING

    def features(self, words: set[str]) -> list[float]:
        """Differences of the two most telling windows, the best ratio of lengths, and the most saved."""
        self.known.turn()
        for w in self.known.absent(words):
            self.known[w] = self.window(w)
        lengths = [x for x in map(self.known.__getitem__, words) if x is not _NOTHING and x[0]]
        by = sorted((o - 2 * t for t, o, _ in lengths), reverse=True)[:2]
        by += [-30] * (2 - len(by))
        both = max((o / t + 1 - t / n for t, o, n in lengths), default=0.0)
        return [max(by[0], -30) / 10, max(by[1], -30) / 10, max((o / t for t, o, _ in lengths), default=0.0),
                max((1 - t / n for t, _, n in lengths), default=0.0), both]


def _ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """Likelihood ratio of a word's document counts in two groups; 0 where the first has it no more often."""
    if a * n_b <= b * n_a:
        return 0.0
    e, f = (a + b) * n_a / (n_a + n_b), (a + b) * n_b / (n_a + n_b)
    return 2 * (a * math.log(a / e) + (b * math.log(b / f) if b else 0.0))


def evidence(texts: list[set[str]], toxic: np.ndarray) -> tuple[dict[str, float], Counter]:
    """Likelihood ratios of the words of toxic documents, and document counts of the words of ordinary ones."""
    n = [int((toxic == k).sum()) for k in (0, 1)]
    count = [Counter(), Counter()]
    for words, k in zip(texts, toxic.tolist()):
        count[k].update(words)
    return {w: _ratio(a, count[0][w], n[1], n[0]) for w, a in count[1].items() if a >= LEAST_DOCUMENTS}, count[0]


def train(ratio: dict[str, float], count: Counter, least: float) -> tuple[list[str], list[str]]:
    """The words of both dictionaries, the most telling (or frequent) last, where offsets are short."""
    chosen = sorted((w for w, r in ratio.items() if r >= least), key=lambda w: (ratio[w], w))[-TOXIC_WORDS:]
    telling = set(chosen)
    ordinary = sorted((w for w, k in count.items() if k > 1 and w not in telling), key=lambda w: (count[w], w))
    return chosen, ordinary[-ORDINARY_WORDS:]


def folds(toxic: np.ndarray) -> np.ndarray:
    """The fold of every document, dealt out label by label."""
    fold = np.zeros(len(toxic), np.int64)
    for k in (0, 1):
        fold[toxic == k] = np.arange(int((toxic == k).sum())) % FOLDS
    return fold


def cross_fitted(texts: list[set[str]], toxic: np.ndarray) -> list[np.ndarray]:
    """For each of ``LEAST_RATIOS`` the features of every document by dictionaries of the other folds."""
    fold, out = folds(toxic), [np.zeros((len(texts), FEATURES)) for _ in LEAST_RATIOS]
    for f in range(FOLDS):
        held = np.flatnonzero(fold == f)
        found = evidence([t for t, k in zip(texts, fold.tolist()) if k != f], toxic[fold != f])
        for x, least in zip(out, LEAST_RATIOS):
            distance = Distance(*train(*found, least))
            for i in held:
                x[i] = distance.features(texts[i])
    return out


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Weights whose score is 0.5 where the fewest documents are on the wrong side, their number, and the log loss."""
    w = logistic(x, y)
    p = probability(x, w)
    loss = -float(np.log(np.where(y == 1, p, 1 - p) + 1e-12).mean())
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    wrong[1:-1][p[1:] == p[:-1]] = len(y)  # no cut between equal scores
    at = np.flatnonzero(wrong == wrong.min())
    at = int(at[len(at) // 2])
    edge = np.log(p / (1 - p + 1e-12) + 1e-12)
    w[-1] -= (edge[max(0, at - 1)] + edge[min(at, len(edge) - 1)]) / 2
    return w, int(wrong.min()), loss


def fit(docs: DataFrame, labels: DataFrame, may_train, rows: int = SAMPLE):
    """Both dictionaries' words and the calibrated weights; None without both labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(["\n".join(sorted(distinct_words(t))) for t in texts_of(b)])], ["label", "words"])

    found = sample(docs.where(F.length("text") <= SAMPLE_CHARS), labels, "toxic", may_train, rows).select("doc_id", "text", "label")
    # Equal word sets count once: copies would make their own words look frequent.
    found = sorted({r.words: r.label for r in sorted(found.mapInArrow(run, "label int, words string").collect(), key=lambda r: (r.words, r.label))}.items())
    toxic = np.array([label for _, label in found], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    texts = [set(words.split("\n")) if words else set() for words, _ in found]
    found = evidence(texts, toxic)
    if min(np.bincount(toxic)) < 2:  # no other fold would know the label
        words = train(*found, LEAST_RATIOS[0])
        distance = Distance(*words)
        return words, calibrated(np.array([distance.features(t) for t in texts]), toxic)[0]
    tried = [calibrated(x, toxic) for x in cross_fitted(texts, toxic)]
    best = min(range(len(tried)), key=lambda i: tried[i][1:])
    return train(*found, LEAST_RATIOS[best]), tried[best][0]


def batch_scores(batch: pa.RecordBatch, fitted) -> np.ndarray:
    """The score of every text of an Arrow batch."""
    words, w = fitted
    distance = held(("toxicity", hash((tuple(words[0]), tuple(words[1])))), lambda: Distance(*words))
    return probability(np.array([distance.features(distinct_words(t)) for t in texts_of(batch)]).reshape(-1, FEATURES), w)


def score(docs: DataFrame, fitted) -> DataFrame:
    """``doc_id, score, predicted`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.zeros(b.num_rows) if fitted is None else batch_scores(b, fitted)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows whose id's crc32 leaves 0 modulo 5 never train."""
    out = score(docs, fit(docs, labels, remainder(5) != 0, rows))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: one row per document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
