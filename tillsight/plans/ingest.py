"""One ingest commit: gate, read, map, validate, store, register, report.

A batch is a folder of files.  Its rows are staged once; the report and a
content fingerprint come from the staged table, and only datasets that pass
are written, as partitions named by a file id that follows from the file's
name and content.  The manifest gets its rows last and only for ids it does
not hold, and readers find data through the manifest: a batch that breaks
off leaves nothing visible, and running it again ends in the same state.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import normalize_sales
from ..operators.headers import CANONICAL, mapping_table
from ..operators.quality import failures, ingest_message, validation_report
from ..session import broadcast_if_bounded, cut_lineage, ensure_checkpoint_dir
from ..sources import stores
from ..sources.csv_files import list_files
from ..sources.csv_records import MAX_BROADCAST, sales_columns, scan_csv


@dataclass
class Store:
    """Places of the tables: normalised sales by ``file_id``, records of too many fields, and the manifest log."""

    base: str

    def __post_init__(self):
        self.sales, self.rejects, self.manifest = (f"{self.base.rstrip('/')}/{x}" for x in ("sales", "rejects", "manifest"))


@dataclass
class Batch:
    files: DataFrame       # every listed file, with the gate's verdict
    rows: DataFrame        # staged canonical text rows
    rejected: DataFrame    # staged records of too many fields
    decisions: DataFrame   # dataset_id, file_id, row_count, column_count, is_valid, problems


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/ingest/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprints(rows: DataFrame) -> DataFrame:
    """``dataset_id, print``: a digest of each dataset's rows that does not depend on their order or partitioning."""
    values = [F.col(c) for c in CANONICAL] + [F.map_entries("other")]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return rows.groupBy("dataset_id").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("print"))


def file_id(name: Column, content: Column) -> Column:
    """A positive 63-bit id from a file's name and fingerprint."""
    return F.xxhash64(name, content).bitwiseAND(F.lit((1 << 63) - 1))


def stage(spark: SparkSession, path: str, max_bytes: int | None = None) -> Batch:
    """Read a folder once, and decide on each of its files."""
    files = list_files(spark, path, max_bytes=max_bytes)
    accepted = [r.path for r in files.where("accepted").select("path").collect()]  # names only, as the listing itself
    records, wide, names = scan_csv(spark, accepted)
    rows = _staged(sales_columns(records, names), "rows")
    rejected = _staged(wide.select("dataset_id", "start", "pos", "labels", "fields"), "rejected")
    headers = names.select("dataset_id", F.posexplode("names").alias("pos", "header"))
    of = lambda c: F.max(F.when(F.col("canonical") == c, F.col("header")))
    mapped = mapping_table(headers).groupBy("dataset_id").agg(
        F.collect_set("canonical").alias("mapped"), of("order_date").alias("date_header"), of("net_revenue").alias("revenue_header"))
    datasets = names.select("dataset_id", F.size("labels").alias("column_count")).join(mapped, "dataset_id", "left").withColumn(
        "mapped", F.coalesce("mapped", F.array().cast("array<string>")))
    report = validation_report(rows, datasets)
    problems = failures(report).withColumnRenamed("message", "problems")
    decided = report.select("dataset_id", "row_count", "column_count", "is_valid").join(problems, "dataset_id", "left")
    decided = decided.join(fingerprints(rows), "dataset_id", "left").join(
        files.select(F.col("path").alias("dataset_id"), "file_name"), "dataset_id")
    decided = decided.withColumn("file_id", file_id(F.col("file_name"), F.coalesce("print", F.lit("0")))).drop("print", "file_name")
    return Batch(files, rows, rejected, cut_lineage(decided))


def write_data(batch: Batch, store: Store) -> None:
    """Normalised rows of the datasets that pass, and their records of too many fields; a partition is replaced as a whole."""
    ids = broadcast_if_bounded(batch.decisions.where("is_valid").select("dataset_id", "file_id"), MAX_BROADCAST)
    for rows, place in ((normalize_sales(batch.rows.join(ids, "dataset_id"), keys=("dataset_id", "file_id")), store.sales),
                        (batch.rejected.join(ids, "dataset_id"), store.rejects)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(place)


def register_files(batch: Batch, store: Store) -> None:
    """Manifest rows of the stored datasets that the manifest does not hold."""
    spark = batch.rows.sparkSession
    f = batch.files.select(F.col("path").alias("dataset_id"), F.col("file_name").alias("original_name"),
                           F.col("length").alias("file_size"), F.col("modified").alias("uploaded_at"))
    new = batch.decisions.where("is_valid").join(f, "dataset_id").select(
        F.col("file_id").alias("id"), "dataset_id", "original_name", "file_size", "row_count", "column_count",
        F.lit("processed").alias("status"), "uploaded_at", F.current_timestamp().alias("event_at"))
    new = new.dropDuplicates(["id"]).join(stores.read_manifest(spark, store.manifest).select("id"), "id", "left_anti")
    stores.append_manifest(cut_lineage(new), store.manifest)


def outcome(batch: Batch) -> DataFrame:
    """``path, file_name, file_id, accepted, row_count, message`` of every listed file."""
    d = batch.files.select("path", "file_name", F.col("accepted").alias("_gate"), "reason").join(
        batch.decisions.withColumnRenamed("dataset_id", "path"), "path", "left")
    accepted = F.col("_gate") & F.coalesce("is_valid", F.lit(False))
    message = (F.when(~F.col("_gate"), F.concat(F.lit("Rejected '"), "file_name", F.lit("': "), "reason"))
               .when(accepted, ingest_message(F.col("file_name"), F.col("row_count")))
               .otherwise(F.concat(F.lit("Data quality issues in '"), "file_name", F.lit("': "), F.coalesce("problems", F.lit("no header")))))
    return d.select("path", "file_name", F.when(accepted, F.col("file_id")).alias("file_id"), accepted.alias("accepted"),
                    F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"), message.alias("message"))


def ingest(spark: SparkSession, path: str, store: Store, max_bytes: int | None = None) -> DataFrame:
    """Take in a folder of files; the outcome for each of them.  Safe to repeat."""
    batch = stage(spark, path, max_bytes)
    write_data(batch, store)
    register_files(batch, store)
    return outcome(batch)


def purge(spark: SparkSession, store: Store, keep_seconds: int = 3600) -> list[int]:
    """Remove the data of datasets deleted more than ``keep_seconds`` ago; the ids removed.

    Younger deletions wait, so that queries which began before them can end.  Only partitions of ids whose newest
    manifest row is a deletion are touched.
    """
    if not stores._exists(spark, store.manifest):
        return []
    newest = stores.latest_per_key(spark.read.parquet(store.manifest), ["id"], ["event_at"])
    old = F.col("event_at") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(keep_seconds))
    gone = [r.id for r in newest.where((F.col("status") == "deleted") & old).select("id").collect()]  # ids of one clean-up
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = []
    for i in gone:
        for place in (store.sales, store.rejects):
            p = jvm.org.apache.hadoop.fs.Path(f"{place}/file_id={i}")
            if p.getFileSystem(conf).delete(p, True) and i not in removed:
                removed.append(i)
    return sorted(removed)
