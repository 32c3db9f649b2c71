"""Chart-ready series (data only, no styling).

Every chart is a long table ``(keys..., chart, series, pos, label, value)``:
one row per plotted point, ``pos`` the 0-based position on the x axis.
Long tables union, filter and partition like any other result; nested
``labels``/``datasets`` arrays are built only at the sink
(:func:`to_payload`), from already-aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A

CHART_COLUMNS = ("chart", "series", "pos", "label", "value")


def _points(df: DataFrame, chart: str, label, order, series: dict, keys: Sequence[str]) -> DataFrame:
    """Positions by ``order`` within keys, then one row per (point, series)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    base = df.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    stack = ", ".join(f"'{name}', CAST({col} AS DOUBLE)" for name, col in series.items())
    return base.select(
        *keys, F.lit(chart).alias("chart"), "pos", label.alias("label"),
        F.expr(f"stack({len(series)}, {stack}) AS (series, value)"),
    ).select(*keys, *CHART_COLUMNS)


# --------------------------------------------------------------------- C1
def chart_trend(src, include_orders: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    m = A.monthly_sales(src, keys)
    series = {"revenue": "revenue", "orders": "orders"} if include_orders else {"revenue": "revenue"}
    return _points(m, "trend", F.col("month"), [F.col("month")], series, keys)


# --------------------------------------------------------------------- C2
def chart_products(src, limit: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    p = A.top_products(src, limit, keys)
    return _points(p, "products", F.col("product"), [F.col("rank")], {"revenue": "revenue"}, keys)


# --------------------------------------------------------------------- C3
def chart_category(src, keys: Sequence[str] = ()) -> DataFrame:
    c = A.category_sales(src, keys)
    return _points(c, "category", F.col("category"), [F.desc("revenue"), F.col("category")],
                   {"revenue": "revenue"}, keys)


# --------------------------------------------------------------------- C4
def chart_region(src, keys: Sequence[str] = ()) -> DataFrame:
    r = A.region_sales(src, keys)
    return _points(r, "region", F.col("region"), [F.desc("revenue"), F.col("region")],
                   {"revenue": "revenue", "orders": "orders"}, keys)


# --------------------------------------------------------------------- C5
def chart_weekly(src, keys: Sequence[str] = ()) -> DataFrame:
    wk = A.weekly_sales(src, keys)
    return _points(wk, "weekly", F.date_format("week_start", "yyyy-MM-dd"), [F.col("week_start")],
                   {"revenue": "revenue"}, keys)


# ------------------------------------------------------------------ C6 T3
def units_leaders(src, limit: int = 8, keys: Sequence[str] = (), by: str = "revenue") -> DataFrame:
    """Products re-sorted by units sold.

    ``by='revenue'`` (the reference behaviour): take the top ``limit`` by
    revenue, then order those by units.  ``by='units'``: the top ``limit``
    by units directly.
    """
    keys = list(keys)
    if by == "revenue":
        p = A.top_products(src, limit, keys)
    elif by == "units":
        f = A.as_source(src, keys).facts(keys + ["product"])
        per = f.groupBy(*keys, "product").agg(F.sum("net_revenue").alias("_rev"),
                                              F.sum("quantity").alias("units_sold"))
        w = Window.partitionBy(*keys).orderBy(F.desc("units_sold"), F.desc("_rev"), "product")
        p = (per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
             .select(*keys, "product", A.money_out("_rev").alias("revenue"), "units_sold",
                     F.col("rank").cast("int").alias("rank")))
    else:
        raise ValueError("by must be 'revenue' or 'units'")
    w = Window.partitionBy(*keys).orderBy(F.desc("units_sold"), "rank")
    return (p.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
            .select(*keys, "pos", "product", "units_sold", "revenue", F.col("rank").alias("revenue_rank"))
            .orderBy(*keys, "pos"))


def chart_units(src, limit: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    u = units_leaders(src, limit, keys)
    return u.select(*keys, F.lit("units").alias("chart"), F.lit("units_sold").alias("series"), "pos",
                    F.col("product").alias("label"), F.col("units_sold").cast("double").alias("value"))


# --------------------------------------------------------------------- C8
def chart_bundle(src, keys: Sequence[str] = ()) -> DataFrame:
    """Trend, products, category and region charts as one long table."""
    src = A.as_source(src, keys)
    parts = [chart_trend(src, True, keys), chart_products(src, 8, keys),
             chart_category(src, keys), chart_region(src, keys)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_payload(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long chart rows -> one row per (keys, chart) with ``labels`` and
    ``datasets`` arrays, padded with NULL where a series has no point."""
    keys = list(keys)
    labels = (long.groupBy(*keys, "chart", "pos").agg(F.first("label").alias("label"))
              .groupBy(*keys, "chart")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("_l"),
                   F.max("pos").alias("_n")))
    series = (long.groupBy(*keys, "chart", "series")
              .agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_m")))
    joined = series.join(labels, keys + ["chart"])
    data = F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.element_at(F.col("_m"), i))
    ds = joined.select(*keys, "chart", "_l", F.struct(F.col("series").alias("label"), data.alias("data")).alias("ds"))
    return (ds.groupBy(*keys, "chart")
            .agg(F.first("_l").alias("_l"), F.array_sort(F.collect_list("ds")).alias("datasets"))
            .select(*keys, "chart", F.transform("_l", lambda s: s["label"]).alias("labels"), "datasets"))


def payload_points(payload: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A payload's points as rows again: ``chart, series, pos, label, value``."""
    points = payload.select(*keys, "chart", "labels", F.inline("datasets")).withColumnRenamed("label", "series")
    return (points.select(*keys, "chart", "series", "labels", F.posexplode("data").alias("pos", "value"))
            .withColumn("label", F.get("labels", F.col("pos"))).select(*keys, *CHART_COLUMNS))


# --------------------------------------------------------------------- C9
def forecast_boundary(chart: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First forecast position and the lower-upper range text per key."""
    keys = list(keys)
    g = chart.groupBy(*keys) if keys else chart.groupBy()
    return g.agg(
        F.min(F.when(F.col("series") == "predicted", F.col("pos"))).alias("first_forecast_pos"),
        F.min(F.when(F.col("series") == "lower", F.col("value"))).alias("range_low"),
        F.max(F.when(F.col("series") == "upper", F.col("value"))).alias("range_high"),
    ).withColumn("range_text", F.concat(F.lit("$"), F.format_number("range_low", 0), F.lit(" - $"),
                                         F.format_number("range_high", 0)))


# --------------------------------------------------------------------- C7
def chart_forecast(series: DataFrame, points: DataFrame, keys: Sequence[str] = (),
                   history_days: int = 60) -> DataFrame:
    """Last ``history_days`` days of history followed by the forecast.

    Series ``history`` (actual revenue), ``predicted``, ``upper`` and
    ``lower``; forecast positions continue after the history.
    """
    keys = list(keys)
    w_desc = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    hist = series.withColumn("_r", F.row_number().over(w_desc)).where(F.col("_r") <= history_days)
    w = Window.partitionBy(*keys).orderBy("ds")
    hist = hist.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    g = hist.groupBy(*keys) if keys else hist.groupBy()
    n_hist = g.agg(F.count(F.lit(1)).cast("int").alias("_n"))
    h = hist.select(*keys, F.lit("forecast").alias("chart"), F.lit("history").alias("series"), "pos",
                    F.date_format("ds", "yyyy-MM-dd").alias("label"),
                    F.round(F.col("y").cast("double"), 2).alias("value"))
    p = points.join(n_hist, keys) if keys else points.crossJoin(n_hist)
    stack = "stack(3, 'predicted', predicted_revenue, 'upper', upper_bound, 'lower', lower_bound) AS (series, value)"
    f = p.select(*keys, F.lit("forecast").alias("chart"), (F.col("_n") + F.col("step")).cast("int").alias("pos"),
                 F.date_format("ds", "yyyy-MM-dd").alias("label"), F.expr(stack))
    return h.unionByName(f.select(*keys, *CHART_COLUMNS))
