"""Canonical sales facts over the driver's TPC-H-style star schema.

Mapping (one sales row per line item):

=============  ===========================================================
order_date     ``o_orderdate`` (lines whose order or date is missing drop)
net_revenue    ``l_extendedprice * (1 - l_discount)`` as exact decimal
quantity       ``l_quantity`` truncated to BIGINT, missing -> 1
product        ``p_name``        (left join, missing -> 'Unknown')
category       ``p_type``        (left join, missing -> 'Unknown')
region         ``r_name`` via customer -> nation -> region (left joins)
customer_id    ``o_custkey`` as text
=============  ===========================================================

Only the tables a request needs are joined (an inner join cannot be removed
by the optimizer, so asking for ``order_date`` alone must not touch
``part``).  Before each join to a large dimension the facts are summed at
the grain of the join key plus the other requested dimensions, so the
shuffle carries one partial row per key and map task instead of every line;
a hot key (one order or one part holding a third of all lines) is collapsed
by the map-side partial aggregate instead of landing in one reduce task.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import MONEY
from ..functions.text import dimension
from .sales import SalesSource, check_dims, measure_sums


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def line_revenue() -> "F.Column":
    price = F.col("l_extendedprice").try_cast("decimal(18,2)")
    disc = F.col("l_discount").try_cast("decimal(4,2)")
    return F.coalesce((price * (F.lit(1) - disc)).try_cast(MONEY), F.lit(0).cast(MONEY))


def line_quantity() -> "F.Column":
    return F.coalesce(F.col("l_quantity").try_cast("bigint"), F.lit(1).cast("bigint"))


class StarSales(SalesSource):
    """Sales facts from ``lineitem`` / ``orders`` / ``part`` / ``customer`` /
    ``nation`` / ``region`` parquet tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self.sf_dir = sf_dir

    @property
    def spark(self) -> SparkSession:
        return self._spark

    def table(self, name: str) -> DataFrame:
        return read_table(self._spark, self.sf_dir, name)

    def geography(self) -> DataFrame:
        """nation key -> region name (25 rows in TPC-H).

        No broadcast is forced: the planner broadcasts it by its bytes.
        """
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        region = self.table("region").select("r_regionkey", "r_name")
        return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select("n_nationkey", "r_name")

    def facts(self, dims: Sequence[str] = ()) -> DataFrame:
        dims = check_dims(dims)
        need_part = bool({"product", "category"} & set(dims))
        need_region = "region" in dims
        need_cust = need_region or "customer_id" in dims
        need_date = "order_date" in dims

        lines = self.table("lineitem")
        if need_part:
            f = lines.select(
                "l_orderkey", "l_partkey",
                line_revenue().alias("net_revenue"),
                line_quantity().alias("quantity"),
                F.lit(1).cast("bigint").alias("line_count"))
        else:
            # Eager aggregation to order grain; the join below reuses this
            # hash partitioning on the order key.
            f = (lines.groupBy("l_orderkey")
                 .agg(F.sum(line_revenue()).alias("net_revenue"),
                      F.sum(line_quantity()).alias("quantity"),
                      F.count(F.lit(1)).alias("line_count")))

        ocols = ["o_orderkey"]
        if need_date:
            ocols.append("o_orderdate")
        if need_cust:
            ocols.append("o_custkey")
        orders = self.table("orders").where(F.col("o_orderdate").isNotNull()).select(*ocols)
        f = f.join(orders, f.l_orderkey == orders.o_orderkey).drop("l_orderkey", "o_orderkey")
        grain = (["o_orderdate"] if need_date else []) + (["l_partkey"] if need_part else [])

        if need_region:
            # Sum to (customer, rest of the grain) before the customer join.
            f = f.groupBy("o_custkey", *grain).agg(*measure_sums())
            cust = self.table("customer").select("c_custkey", "c_nationkey")
            f = (f.join(cust, f.o_custkey == cust.c_custkey, "left")
                 .join(self.geography(), F.col("c_nationkey") == F.col("n_nationkey"), "left")
                 .withColumn("region", dimension("r_name"))
                 .drop("c_custkey", "c_nationkey", "n_nationkey", "r_name"))

        if need_part:
            rest = [c for c in grain if c != "l_partkey"]
            keep = (["region"] if need_region else []) + (["o_custkey"] if "customer_id" in dims else [])
            # Sum to (part, rest of the grain) before the part join: a hot
            # part then arrives as one partial row per map task.
            f = f.groupBy("l_partkey", *rest, *keep).agg(*measure_sums())
            part = self.table("part").select(
                "p_partkey",
                dimension("p_name").alias("product"),
                dimension("p_type").alias("category"))
            f = f.join(part, f.l_partkey == part.p_partkey, "left").drop("p_partkey")
            f = (f.withColumn("product", F.coalesce("product", F.lit("Unknown")))
                 .withColumn("category", F.coalesce("category", F.lit("Unknown"))))

        out = []
        for d in dims:
            if d == "order_date":
                out.append(F.col("o_orderdate").cast("timestamp").alias("order_date"))
            elif d == "customer_id":
                out.append(dimension(F.col("o_custkey").cast("string")).alias("customer_id"))
            else:
                out.append(F.col(d))
        return f.select(*out, "net_revenue", "quantity", "line_count")

    def lines(self) -> DataFrame:
        """The full canonical table, one row per line item (all dimensions)."""
        return self.facts(("order_date", "product", "category", "region", "customer_id"))


# SQL for the same canonical table, for the DuckDB oracle.
SALES_SQL = """
sales AS (
  SELECT CAST(o.o_orderdate AS TIMESTAMP) AS order_date,
         COALESCE(CAST(CAST(l.l_extendedprice AS DECIMAL(18,2))
                       * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(24,4)),
                  CAST(0 AS DECIMAL(24,4))) AS net_revenue,
         COALESCE(CAST(TRUNC(l.l_quantity) AS BIGINT), 1) AS quantity,
         CAST(1 AS BIGINT) AS line_count,
         COALESCE(TRIM(p.p_name), 'Unknown') AS product,
         COALESCE(TRIM(p.p_type), 'Unknown') AS category,
         COALESCE(TRIM(r.r_name), 'Unknown') AS region,
         COALESCE(CAST(o.o_custkey AS VARCHAR), 'Unknown') AS customer_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderdate IS NOT NULL
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""
