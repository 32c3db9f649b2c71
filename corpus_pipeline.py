"""A training-data pipeline over ``documents``: clean, safe, distinct, redacted, packed.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next one's ``docs``.  All but the last keep the
columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import near_dedup, packing, pii, quality_crf, toxicity, word_bpe
from tillsight.llm.common import held, release, rows_of, small_batches, stored
from tillsight.llm.labelled import remainder

#: Words of a shingle in the distinct stage.
SHINGLE = 5


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores 0.5 or more."""
    small_batches(spark)
    fitted = quality_crf.fit(docs, _labels(spark, sf_dir), remainder(3) != 1)
    return docs if fitted is None else _filtered(docs, lambda b: quality_crf.batch_scores(b, fitted) >= 0.5)


def safety(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance scores below 0.5."""
    small_batches(spark)
    fitted = toxicity.fit(docs, _labels(spark, sf_dir), remainder(5) != 0)
    return docs if fitted is None else _filtered(docs, lambda b: toxicity.batch_scores(b, fitted) < 0.5)


def _filtered(docs: DataFrame, decide) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(decide(b)))
        release()

    return docs.mapInArrow(run, docs.schema)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (sets of five-word shingles, similarity 0.8): one of the smallest id."""
    small_batches(spark)
    return near_dedup.distinct_rows(docs, k=SHINGLE)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; ``n_chars`` follows the text."""
    small_batches(spark)
    trained = pii.train(pii.labelled_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held("pii", lambda: trained)
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            for row, end, data, offsets in rows_of(b):
                for i, (_, spans) in enumerate(pii.find(data, offsets, model)):
                    if spans:
                        texts[row + i] = pii.redact(texts[row + i], pii.line(spans))
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
        release()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(word_bpe.VOCABULARY))


STAGES = [("quality", quality), ("safety", safety), ("distinct", distinct), ("redacted", redacted), ("packed", packed)]

#: No SQL: classifiers and packing are beyond it; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
