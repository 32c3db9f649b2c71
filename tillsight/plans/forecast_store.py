"""Stored forecasts of many series: only series whose content changed are trained again.

A series is known by its keys and a fingerprint of its days and values that
does not depend on their order.  The store is an append-only log with one
row per trained series: fingerprint, horizon, test metrics and the points as
JSON text (at most the horizon's length).  An anti-join finds the series
without a row; the others are read back.  A run that breaks off has stored
nothing or whole rows, and can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import stores
from .forecast import HORIZON
from .linear import linear_forecast

METRICS = ("mae", "rmse", "r2_score", "training_samples", "test_samples")


def series_fingerprints(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., n_days, print)``: days, and the sum of 60-bit hashes of every day and value, of each series."""
    row = F.concat_ws(" ", F.date_format("ds", "yyyy-MM-dd"), F.col("y").cast("string"))
    value = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.sum(value).cast("string").alias("print"))


def _stored(spark, path: str, keys: Sequence[str], horizon: int) -> DataFrame | None:
    if not stores._exists(spark, path):
        return None
    log = spark.read.parquet(path).where(F.col("horizon") == horizon)
    return stores.latest_per_key(log, [*keys, "n_days", "print"], ["created_at"])


def forecast_many(series: DataFrame, keys: Sequence[str], path: str, horizon: int = HORIZON) -> tuple[DataFrame, DataFrame]:
    """``(points, metrics)`` of every series that can be trained, from the store where its content is known."""
    spark, keys = series.sparkSession, list(keys)
    known = cut_lineage(series_fingerprints(series, keys))
    held = _stored(spark, path, keys, horizon)
    same = [*keys, "n_days", "print"]
    lacking = known if held is None else cut_lineage(known.join(held.select(*same), same, "left_anti"))
    if not lacking.isEmpty():
        points, metrics = linear_forecast(series.join(lacking.select(*keys), keys, "left_semi"), keys, horizon)
        text = F.to_json(F.array_sort(F.collect_list(F.struct(
            "step", F.date_format("ds", "yyyy-MM-dd").alias("date"), "predicted_revenue", "lower_bound", "upper_bound"))))
        rows = points.groupBy(*keys).agg(text.alias("prediction_json")).join(metrics, keys).join(lacking, keys)
        rows.withColumns({"horizon": F.lit(horizon), "created_at": F.current_timestamp()}).write.mode("append").parquet(path)
        held = _stored(spark, path, keys, horizon)
    hit = held.join(known, same, "left_semi")
    points = hit.select(*keys, F.inline(F.from_json("prediction_json", stores.POINT_SCHEMA)))
    points = points.select(*keys, "step", F.to_date("date").alias("ds"), "predicted_revenue", "lower_bound", "upper_bound")
    return points, hit.select(*keys, *METRICS)
