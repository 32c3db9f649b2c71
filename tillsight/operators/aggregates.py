"""KPIs and grouped sales aggregates (monthly, weekly, daily, by product,
region and category), with shares, ranks and growth.

Every function takes a sales source (or a canonical DataFrame) and an
optional list of ``keys`` to compute the same figures per group (for
example per dataset or per region).  Aggregates are sums over the additive
measures, so Spark plans a partial (map-side) and a final aggregate around
one shuffle on the grouping keys.  Windows used for ranks, shares and
growth only ever see already-aggregated rows, partitioned by ``keys``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_label, week_start
from ..functions.numbers import as_double, money_out, safe_div
from ..sources.sales import CanonicalSales, SalesSource, measure_sums


def as_source(src: SalesSource | DataFrame, keys: Sequence[str] = ()) -> SalesSource:
    if isinstance(src, SalesSource):
        return src
    return CanonicalSales(src, keys=keys)


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def _revenue_sum(df: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    return df.groupBy(*by).agg(*measure_sums())


# --------------------------------------------------------------------- A1
def kpi_totals(src, keys: Sequence[str] = (), approx_customers: bool = False) -> DataFrame:
    """Total revenue, order rows, average order value, distinct customers.

    ``approx_customers`` counts customers with HyperLogLog++
    (``approx_count_distinct``, ~2% error) instead of an exact distinct,
    which avoids shuffling every customer id at very large scale.
    """
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["customer_id"])
    distinct = (F.approx_count_distinct("customer_id") if approx_customers
                else F.countDistinct("customer_id"))
    agg = _grouped(f, keys).agg(
        F.sum("net_revenue").alias("_rev"),
        F.sum("line_count").alias("_rows"),
        distinct.alias("unique_customers"))
    rows = F.coalesce(F.col("_rows"), F.lit(0)).cast("bigint")
    return agg.select(
        *keys,
        F.coalesce(money_out("_rev"), F.lit(0.0)).alias("total_revenue"),
        rows.alias("total_orders"),
        F.coalesce(F.round(safe_div(F.col("_rev"), rows), 2), F.lit(0.0)).alias("avg_order_value"),
        F.col("unique_customers").cast("bigint").alias("unique_customers"))


# ------------------------------------------------------------------ A2 A3
def top_by(src, dim: str, keys: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """The ``dim`` value with the largest summed revenue (ties: smallest value).

    A single ``min_by`` over (-revenue, value) is a decomposable aggregate,
    so no sort of all groups is needed.
    """
    keys = list(keys)
    f = as_source(src, keys).facts(keys + [dim])
    per = _revenue_sum(f, keys + [dim])
    order = F.struct(-F.col("net_revenue"), F.col(dim))
    return _grouped(per, keys).agg(F.min_by(F.col(dim), order).alias(out or f"top_{dim}"))


def top_product(src, keys: Sequence[str] = ()) -> DataFrame:
    return top_by(src, "product", keys)


def top_region(src, keys: Sequence[str] = ()) -> DataFrame:
    return top_by(src, "region", keys)


# ------------------------------------------------------------------ A6 W3
def monthly_sales(src, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue and order rows per calendar month, chronological."""
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["order_date"])
    per = _revenue_sum(f, keys + [F.date_trunc("month", "order_date").alias("_m")])
    return (per.select(*keys, month_label("_m").alias("month"),
                       money_out("net_revenue").alias("revenue"),
                       F.col("line_count").alias("orders"))
            .orderBy(*keys, "month"))


def _monthly_exact(src, keys: Sequence[str]) -> DataFrame:
    f = as_source(src, keys).facts(list(keys) + ["order_date"])
    per = _revenue_sum(f, list(keys) + [F.date_trunc("month", "order_date").alias("_m")])
    return per.select(*keys, month_label("_m").alias("month"), "net_revenue")


def growth_pct(cur: Column, prev: Column) -> Column:
    """Percent change rounded to 2 decimals; NULL when prev is 0 or NULL."""
    return F.round(safe_div(as_double(cur) - as_double(prev), prev) * F.lit(100.0), 2)


def month_over_month(src, keys: Sequence[str] = ()) -> DataFrame:
    """Every month with its previous month's revenue and the % change."""
    keys = list(keys)
    m = _monthly_exact(src, keys)
    w = Window.partitionBy(*keys).orderBy("month")
    prev = F.lag("net_revenue", 1).over(w)
    return (m.select(*keys, "month",
                     money_out("net_revenue").alias("revenue"),
                     money_out(prev).alias("prev_revenue"),
                     growth_pct(F.col("net_revenue"), prev).alias("growth_pct"))
            .orderBy(*keys, "month"))


# --------------------------------------------------------------------- A4
def mom_growth(src, keys: Sequence[str] = ()) -> DataFrame:
    """% change between the last two months present (NULL if < 2 months)."""
    keys = list(keys)
    m = _monthly_exact(src, keys)
    w = Window.partitionBy(*keys).orderBy("month")
    last = Window.partitionBy(*keys).orderBy(F.desc("month"))
    s = (m.withColumn("_prev", F.lag("net_revenue", 1).over(w))
         .withColumn("_rn", F.row_number().over(last))
         .where(F.col("_rn") == 1))
    out = s.select(*keys, growth_pct(F.col("net_revenue"), F.col("_prev")).alias("revenue_growth"))
    if keys:
        return out
    # A global aggregate returns one row, even for an empty table.
    return out.groupBy().agg(F.first("revenue_growth").alias("revenue_growth"))


# --------------------------------------------------------------------- A5
#: Products are ranked in this many buckets first, so that no task sees all of them.
BUCKETS = 64


def totals_by(src: SalesSource, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Totals per ``month`` or dimension value, all ``kinds`` from one read of the facts.

    Rows are ``keys, _kind, _name`` and the measures: grouping sets in long
    form, summed map-side before the one shuffle.
    """
    keys = list(keys)
    f = src.facts(keys + ["order_date" if k == "month" else k for k in kinds])
    names = [month_label("order_date") if k == "month" else F.col(k).cast("string") for k in kinds]
    rows = F.array(*[F.struct(F.lit(k).alias("_kind"), n.alias("_name")) for k, n in zip(kinds, names)])
    return _revenue_sum(f.select(*keys, "net_revenue", "quantity", "line_count", F.inline(rows)),
                        keys + ["_kind", "_name"])


def _best_products(totals: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Drop products that cannot be among the first ``n`` of their key: at most ``BUCKETS * n`` stay."""
    bucket = F.pmod(F.xxhash64("_name"), F.lit(BUCKETS))
    w = Window.partitionBy(*keys, "_kind", bucket).orderBy(F.desc("net_revenue"), F.asc("_name"))
    return (totals.withColumn("_r", F.row_number().over(w))
            .where((F.col("_kind") != "product") | (F.col("_r") <= n)).drop("_r"))


def overview(src, keys: Sequence[str] = (), top_n: int | None = None) -> DataFrame:
    """One row per key: the KPI record, the months, and with ``top_n`` the three lists.

    The facts are read twice, once for what hangs on orders (months, regions,
    customers) and once for what hangs on parts (products, categories); one
    aggregate by key then gathers both.  ``_months`` is sorted (one entry per
    calendar month), ``_products`` holds ``top_n`` entries, ``_regions`` and
    ``_categories`` one per value, all by revenue descending, then name.
    """
    keys = list(keys)
    src = as_source(src, keys)
    parts = totals_by(src, keys, ["product"] if top_n is None else ["product", "category"])
    if top_n is not None:
        parts = _best_products(parts, keys, top_n)
    rows = totals_by(src, keys, ["month", "region", "customer_id"]).unionByName(parts)

    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("_kind") == kind, value)

    def top(kind: str) -> Column:
        return F.min_by("_name", of(kind, F.struct(-F.col("net_revenue"), F.col("_name"))))

    def ranked(kind: str) -> Column:
        item = F.struct((-F.col("net_revenue")).alias("minus"), F.col("_name").alias("name"),
                        F.col("net_revenue").alias("revenue"), F.col("quantity").alias("units"),
                        F.col("line_count").alias("orders"))
        return F.array_sort(F.collect_list(of(kind, item)))

    month = F.struct(F.col("_name").alias("month"), F.col("net_revenue").alias("revenue"), F.col("line_count").alias("orders"))
    lists = [] if top_n is None else [F.slice(ranked("product"), 1, top_n).alias("_products"),
                                      ranked("region").alias("_regions"), ranked("category").alias("_categories")]
    out = _grouped(rows, keys).agg(
        F.sum(of("month", F.col("net_revenue"))).alias("_rev"),
        F.coalesce(F.sum(of("month", F.col("line_count"))), F.lit(0)).cast("bigint").alias("total_orders"),
        F.count(of("customer_id", F.col("_name"))).alias("unique_customers"),
        top("product").alias("top_product"), top("region").alias("top_region"),
        F.array_sort(F.collect_list(of("month", month))).alias("_months"), *lists)
    last, before = F.try_element_at("_months", F.lit(-1)), F.try_element_at("_months", F.lit(-2))
    return out.select(
        *keys, F.coalesce(money_out("_rev"), F.lit(0.0)).alias("total_revenue"), "total_orders",
        F.coalesce(F.round(safe_div(F.col("_rev"), F.col("total_orders")), 2), F.lit(0.0)).alias("avg_order_value"),
        "unique_customers", "top_product", "top_region",
        growth_pct(last["revenue"], before["revenue"]).alias("revenue_growth"),
        *[c for c in out.columns if c.startswith("_")])


#: The columns of the KPI record.
KPIS = ("total_revenue", "total_orders", "avg_order_value", "unique_customers", "top_product", "top_region", "revenue_growth")


def kpis(src, keys: Sequence[str] = ()) -> DataFrame:
    """KPI record: totals, top product, top region, month-over-month growth."""
    return overview(src, keys).select(*keys, *KPIS)


# ------------------------------------------------------------------ A7 W1
def _ranked(per: DataFrame, dim: str, keys: Sequence[str], limit: int | None) -> DataFrame:
    """Rank groups by revenue desc, ``dim`` asc; keep the first ``limit``."""
    order = [F.desc("net_revenue"), F.asc(dim)]
    if not keys:
        if limit is not None:
            # TakeOrderedAndProject: per-partition top-k, then one merge.
            per = per.orderBy(*order).limit(limit)
        w = Window.orderBy(*order)
        return per.withColumn("rank", F.row_number().over(w))
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = per.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit) if limit is not None else ranked


def top_products(src, limit: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Top ``limit`` products by revenue with units sold and rank 1..N."""
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["product"])
    per = _revenue_sum(f, keys + ["product"])
    r = _ranked(per, "product", keys, limit)
    return (r.select(*keys, "product", money_out("net_revenue").alias("revenue"),
                     F.col("quantity").alias("units_sold"), F.col("rank").cast("int").alias("rank"))
            .orderBy(*keys, "rank"))


# ------------------------------------------------------------------ A8 W2
def _with_share(per: DataFrame, keys: Sequence[str], decimals: int) -> DataFrame:
    """Share of the per-key total revenue in percent (0 when total <= 0).

    A window over the already grouped rows (one row per group value),
    partitioned by ``keys``: the facts are read once.
    """
    total = F.sum("net_revenue").over(Window.partitionBy(*keys))
    share = F.when(total > 0, F.round(as_double("net_revenue") / as_double(total) * F.lit(100.0), decimals)
                   ).otherwise(F.lit(0.0))
    return per.withColumn("percentage", share)


def region_sales(src, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue, order rows and share (%) per region, revenue descending."""
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["region"])
    per = _with_share(_revenue_sum(f, keys + ["region"]), keys, 1)
    return (per.select(*keys, "region", money_out("net_revenue").alias("revenue"),
                       F.col("line_count").alias("orders"), "percentage")
            .orderBy(*keys, F.desc("revenue"), "region"))


# --------------------------------------------------------------------- A9
def category_sales(src, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue and units per category, revenue descending."""
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["category"])
    per = _revenue_sum(f, keys + ["category"])
    return (per.select(*keys, "category", money_out("net_revenue").alias("revenue"),
                       F.col("quantity").alias("units_sold"))
            .orderBy(*keys, F.desc("revenue"), "category"))


# -------------------------------------------------------------------- A14
def category_share(src, keys: Sequence[str] = ()) -> DataFrame:
    """Category revenue as a share of the total, 1 decimal."""
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["category"])
    per = _with_share(_revenue_sum(f, keys + ["category"]), keys, 1)
    return (per.select(*keys, "category", money_out("net_revenue").alias("revenue"), "percentage")
            .orderBy(*keys, F.desc("revenue"), "category"))


# -------------------------------------------------------------------- A10
def weekly_sales(src, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue and order rows per Monday-start week (DATE), ascending.

    The week start is a calendar date, so sales at different times of the
    same day fall into the same week.
    """
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["order_date"])
    per = _revenue_sum(f, keys + [week_start("order_date").alias("week_start")])
    return (per.select(*keys, "week_start", money_out("net_revenue").alias("revenue"),
                       F.col("line_count").alias("orders"))
            .orderBy(*keys, "week_start"))


# -------------------------------------------------------------------- A11
def daily_revenue_exact(src, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds DATE, revenue DECIMAL) for days with sales."""
    keys = list(keys)
    f = as_source(src, keys).facts(keys + ["order_date"])
    return (f.groupBy(*keys, F.to_date("order_date").alias("ds"))
            .agg(F.sum("net_revenue").alias("revenue"), F.sum("line_count").alias("orders")))


def daily_revenue(src, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue per calendar day with sales (no gap filling), ascending."""
    keys = list(keys)
    d = daily_revenue_exact(src, keys)
    return (d.select(*keys, "ds", money_out("revenue").alias("revenue"))
            .orderBy(*keys, "ds"))


# -------------------------------------------------------------------- A15
def forecast_total(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of predicted revenue over the forecast horizon."""
    return _grouped(forecast, list(keys)).agg(
        F.round(F.sum("predicted_revenue"), 2).alias("forecast_total"))
