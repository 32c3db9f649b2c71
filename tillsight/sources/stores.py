"""Persistent tables: the file manifest, the forecast cache and models.

All three are plain Parquet folders (or Spark ML model folders) under a
base path the caller chooses - on a cluster a shared file system or object
store.  The manifest is an append-only log: a deletion appends a tombstone
row and readers keep the newest row per id, so no file is rewritten in
place.  The forecast cache is partitioned by dataset and written with
dynamic partition overwrite, which replaces exactly the datasets written.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_bounded

MAX_FILES_BROADCAST = 1_000_000
MANIFEST_SCHEMA = ("id long, dataset_id string, original_name string, file_size long, row_count long, "
                   "column_count int, status string, uploaded_at timestamp, event_at timestamp")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# -------------------------------------------------------------------- W10
def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` columns for every key.

    An aggregate with map-side combine: a key with a third of all rows is
    reduced to one row per map task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*df.columns)


# --------------------------------------------------------------------- S5
def manifest_entries(files: DataFrame, raw: DataFrame, widths: DataFrame, first_id: int = 1) -> DataFrame:
    """One manifest row per accepted file: size, rows, columns, times.

    ``files`` is the gate listing, ``raw`` the canonical text rows (for row
    counts, one aggregate), ``widths`` ``(dataset_id, column_count)``.
    """
    counts = raw.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count"))
    f = (files.where("accepted").select(F.col("path").alias("dataset_id"), F.col("file_name").alias("original_name"),
                                        F.col("length").alias("file_size"), F.col("modified").alias("uploaded_at"))
         .join(widths, "dataset_id", "left").join(counts, "dataset_id", "left"))
    w = Window.orderBy("uploaded_at", "dataset_id")     # new files of one batch only
    return f.select(
        (F.row_number().over(w) + F.lit(first_id - 1)).cast("long").alias("id"), "dataset_id", "original_name",
        "file_size", F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
        F.col("column_count").cast("int"), F.lit("processed").alias("status"), "uploaded_at",
        F.current_timestamp().alias("event_at"))


def append_manifest(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Current registrations (newest event per id; deleted ones removed)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA).drop("event_at")
    log = spark.read.parquet(path)
    return latest_per_key(log, ["id"], ["event_at"]).where("status <> 'deleted'").drop("event_at")


def next_id(spark: SparkSession, path: str) -> int:
    if not _exists(spark, path):
        return 1
    return (spark.read.parquet(path).agg(F.max("id")).collect()[0][0] or 0) + 1


# --------------------------------------------------------------------- S6
def manifest_latest_first(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.desc("uploaded_at"), F.desc("id"))


# --------------------------------------------------------------------- S7
def manifest_lookup(manifest: DataFrame, file_id: int) -> DataFrame:
    """The registration with ``id``; ValueError when there is none."""
    hit = manifest.where(F.col("id") == file_id)
    if not hit.limit(1).collect():
        raise ValueError(f"File with id={file_id} not found.")
    return hit


# --------------------------------------------------------------------- S8
def manifest_delete(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """Append tombstones for ``ids``; returns the removed registrations."""
    current = read_manifest(spark, path)
    gone = current.join(spark.createDataFrame([(int(i),) for i in ids], "id long"), "id", "left_semi")
    tomb = gone.select("id", "dataset_id", "original_name", "file_size", "row_count", "column_count",
                       F.lit("deleted").alias("status"), "uploaded_at", F.current_timestamp().alias("event_at"))
    gone_rows = gone.collect()          # at most len(ids) rows
    tomb.write.mode("append").parquet(path)
    return spark.createDataFrame(gone_rows, current.schema) if gone_rows else current.limit(0)


# -------------------------------------------------------------------- S11
def write_sales(sales: DataFrame, path: str, manifest: DataFrame) -> None:
    """Store normalised sales partitioned by manifest id (``file_id``)."""
    # One manifest row per file: broadcast after proving the bound, so the
    # sales rows are not shuffled by dataset (a few huge partitions).
    ids = broadcast_if_bounded(manifest.select(F.col("id").alias("file_id"), "dataset_id"),
                               MAX_FILES_BROADCAST)
    (sales.join(ids, "dataset_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path))


def load_dataset(spark: SparkSession, sales_path: str, manifest: DataFrame, file_id: int) -> DataFrame:
    """Rows of one dataset; two not-found cases (no record / no data)."""
    manifest_lookup(manifest, file_id)
    if not _exists(spark, os.path.join(sales_path, f"file_id={file_id}")):
        raise ValueError(f"File data not found for file_id={file_id}. It may have been deleted.")
    return spark.read.parquet(sales_path).where(F.col("file_id") == file_id)   # partition pruning


# -------------------------------------------------------------------- S12
def save_forecast(points: DataFrame, metrics: DataFrame, path: str, key: str = "file_id") -> None:
    """Replace the cached forecast of every ``key`` present in ``points``.

    Per key one row: the model metrics and the points as JSON text (at most
    the horizon's length per key).
    """
    pts = (points.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        "step", F.date_format("ds", "yyyy-MM-dd").alias("date"), "predicted_revenue",
        "lower_bound", "upper_bound")))).alias("prediction_json")))
    row = pts.join(metrics, key, "left").withColumn("created_at", F.current_timestamp())
    (row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(key).parquet(path))


# -------------------------------------------------------------------- S13
POINT_SCHEMA = ("array<struct<step:int,date:string,predicted_revenue:double,"
                "lower_bound:double,upper_bound:double>>")


def load_forecast(spark: SparkSession, path: str, key: str = "file_id",
                  value=None) -> tuple[DataFrame, DataFrame] | None:
    """Newest cached (points, metrics) for ``value`` (all keys if None)."""
    if not _exists(spark, path):
        return None
    t = spark.read.parquet(path)
    if value is not None:
        t = t.where(F.col(key) == value)
    t = latest_per_key(t, [key], ["created_at"])
    if value is not None and not t.limit(1).collect():
        return None
    pts = t.select(key, F.inline(F.from_json("prediction_json", POINT_SCHEMA)))
    pts = pts.select(key, "step", F.to_date("date").alias("ds"), "predicted_revenue", "lower_bound", "upper_bound")
    return pts, t.drop("prediction_json")


# -------------------------------------------------------------------- S14
def save_model(model: PipelineModel, base: str, dataset: str, model_type: str) -> str:
    path = os.path.join(base, f"model_{dataset}_{model_type}")
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
