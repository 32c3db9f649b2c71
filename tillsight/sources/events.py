"""The driver's ``events`` table as sales facts (intraday timestamps).

order_date = ``ts``, net_revenue = ``value``, customer_id = ``user_id``,
category = ``event_type``; product and region are absent ('Unknown').
Thirty days of events make a short series with times of day, which is the
case for week/day bucketing and for the "not enough data" forecast branch.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import money
from ..functions.text import dimension
from .sales import CanonicalSales
from .star import read_table


def event_sales(spark: SparkSession, sf_dir: str) -> CanonicalSales:
    ev = read_table(spark, sf_dir, "events").where(F.col("ts").isNotNull())
    df = ev.select(
        F.col("ts").cast("timestamp").alias("order_date"),
        F.coalesce(money("value"), F.lit(0).cast("decimal(24,4)")).alias("net_revenue"),
        dimension(F.col("user_id").cast("string")).alias("customer_id"),
        dimension("event_type").alias("category"))
    return CanonicalSales(df)


EVENTS_SQL = """
sales AS (
  SELECT CAST(ts AS TIMESTAMP) AS order_date,
         COALESCE(CAST(value AS DECIMAL(24,4)), CAST(0 AS DECIMAL(24,4))) AS net_revenue,
         CAST(1 AS BIGINT) AS quantity, CAST(1 AS BIGINT) AS line_count,
         'Unknown' AS product, COALESCE(TRIM(event_type), 'Unknown') AS category, 'Unknown' AS region,
         COALESCE(CAST(user_id AS VARCHAR), 'Unknown') AS customer_id
  FROM events WHERE ts IS NOT NULL
)"""
