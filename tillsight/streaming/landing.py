"""Incremental ingest of a landing folder with Structured Streaming.

New CSV files dropped into a folder are read as a stream, cleaned and
normalised with the same expressions as the batch path, and turned into
daily revenue.  Each micro-batch writes its *partial* daily sums into the
partition ``batch_id=<n>`` of a Parquet folder with dynamic partition
overwrite, so a retried batch replaces its own output instead of adding
to it (idempotent sink), and the stream keeps no aggregation state.
Readers add the partials up (:func:`daily_totals`).

A stream needs one schema, so all files of a landing folder share one
header layout and one date format (given, not inferred: inference would
need to see all data first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import clean_text
from ..operators.clean import normalize_sales
from ..operators.headers import CANONICAL, header_positions, missing_required


def read_landing(spark: SparkSession, folder: str, header: Sequence[str], encoding: str = "UTF-8",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming canonical text columns from CSV files with ``header``."""
    pos = header_positions(spark, header)
    missing = missing_required(pos)
    if missing:
        raise ValueError(f"Missing required columns: {missing}.")
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(len(header))])
    reader = (spark.readStream.schema(schema).option("header", True).option("encoding", encoding)
              .option("quote", '"').option("escape", '"'))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(folder)
    cols = [clean_text(F.col(f"_c{pos[c]}")).alias(c) if c in pos else F.lit(None).cast("string").alias(c)
            for c in CANONICAL]
    return raw.select(F.col("_metadata.file_path").alias("dataset_id"), *cols)


def stream_sales(spark: SparkSession, folder: str, header: Sequence[str], date_format: str,
                 **kw) -> DataFrame:
    """Streaming typed canonical sales (rows with unparseable dates dropped)."""
    return normalize_sales(read_landing(spark, folder, header, **kw), keys=["dataset_id"],
                           date_format=date_format)


def _write_partials(out_path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        partial = (batch.groupBy(F.to_date("order_date").alias("ds"))
                   .agg(F.sum("net_revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))
                   .withColumn("batch_id", F.lit(batch_id)))
        (partial.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_path))
    return write


def start_daily_revenue(sales: DataFrame, out_path: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """Run the stream into ``out_path``; ``available_now`` processes what is
    there and stops, otherwise it keeps running."""
    w = sales.writeStream.foreachBatch(_write_partials(out_path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def daily_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """``(ds, revenue DOUBLE, orders)`` summed over all micro-batches."""
    parts = spark.read.parquet(out_path)
    return (parts.groupBy("ds").agg(F.round(F.sum("revenue"), 2).cast("double").alias("revenue"),
                                    F.sum("orders").alias("orders"))
            .orderBy("ds"))
