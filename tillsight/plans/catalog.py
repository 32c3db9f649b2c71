"""Registered queries: one Spark plan and (where SQL can say it) one
ANSI-SQL oracle per operator, both over the driver's parquet tables.

``QUERIES[name] = (callable(spark, sf_dir) -> DataFrame, sql | None)``.
Column names and types agree between the two; money is summed as DECIMAL
and rounded half-up before it becomes DOUBLE, in both engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from . import charts as C
from . import reports as REP
from ..sources.star import SALES_SQL, StarSales

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def star(spark: SparkSession, sf_dir: str) -> StarSales:
    return StarSales(spark, sf_dir)


def with_sales(body: str) -> str:
    return f"WITH {SALES_SQL}\n{body}"


def R(expr: str, scale: int = 2) -> str:
    """SQL twin of ``money_out``: round the exact decimal, then DOUBLE."""
    return f"CAST(ROUND({expr}, {scale}) AS DOUBLE)"


# ---------------------------------------------------------------- A1..A5
register("kpi_totals", with_sales(f"""
SELECT COALESCE({R('SUM(net_revenue)')}, 0.0) AS total_revenue,
       CAST(COUNT(*) AS BIGINT) AS total_orders,
       COALESCE(ROUND(CAST(SUM(net_revenue) AS DOUBLE) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE), 2), 0.0)
         AS avg_order_value,
       CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS unique_customers
FROM sales"""))(lambda spark, d: A.kpi_totals(star(spark, d)))

register("top_product", with_sales("""
SELECT product AS top_product FROM (
  SELECT product, SUM(net_revenue) AS rev FROM sales GROUP BY product)
ORDER BY rev DESC, product ASC LIMIT 1"""))(lambda spark, d: A.top_product(star(spark, d)))

register("top_region", with_sales("""
SELECT region AS top_region FROM (
  SELECT region, SUM(net_revenue) AS rev FROM sales GROUP BY region)
ORDER BY rev DESC, region ASC LIMIT 1"""))(lambda spark, d: A.top_region(star(spark, d)))

_MONTHLY = """monthly AS (
  SELECT strftime(date_trunc('month', order_date), '%Y-%m') AS month,
         SUM(net_revenue) AS rev, CAST(COUNT(*) AS BIGINT) AS orders
  FROM sales GROUP BY 1)"""

_GROWTH = ("ROUND(CASE WHEN CAST({p} AS DOUBLE) <> 0 THEN (CAST({c} AS DOUBLE) - CAST({p} AS DOUBLE))"
           " / CAST({p} AS DOUBLE) END * 100.0, 2)")

register("mom_growth", with_sales(f""", {_MONTHLY},
lagged AS (SELECT month, rev, LAG(rev) OVER (ORDER BY month) AS prev,
                  ROW_NUMBER() OVER (ORDER BY month DESC) AS rn FROM monthly)
SELECT (SELECT {_GROWTH.format(c='rev', p='prev')} FROM lagged WHERE rn = 1) AS revenue_growth"""
                                  ))(lambda spark, d: A.mom_growth(star(spark, d)))

register("kpis", with_sales(f""", {_MONTHLY},
lagged AS (SELECT month, rev, LAG(rev) OVER (ORDER BY month) AS prev,
                  ROW_NUMBER() OVER (ORDER BY month DESC) AS rn FROM monthly),
tot AS (
  SELECT COALESCE({R('SUM(net_revenue)')}, 0.0) AS total_revenue,
         CAST(COUNT(*) AS BIGINT) AS total_orders,
         COALESCE(ROUND(CAST(SUM(net_revenue) AS DOUBLE) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE), 2), 0.0)
           AS avg_order_value,
         CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS unique_customers
  FROM sales),
tp AS (SELECT product FROM (SELECT product, SUM(net_revenue) AS rev FROM sales GROUP BY product)
       ORDER BY rev DESC, product LIMIT 1),
tr AS (SELECT region FROM (SELECT region, SUM(net_revenue) AS rev FROM sales GROUP BY region)
       ORDER BY rev DESC, region LIMIT 1)
SELECT tot.*, (SELECT product FROM tp) AS top_product, (SELECT region FROM tr) AS top_region,
       (SELECT {_GROWTH.format(c='rev', p='prev')} FROM lagged WHERE rn = 1) AS revenue_growth
FROM tot"""))(lambda spark, d: A.kpis(star(spark, d)))

# ---------------------------------------------------------------- A6..A11
register("monthly_sales", with_sales(f"""
SELECT strftime(date_trunc('month', order_date), '%Y-%m') AS month,
       {R('SUM(net_revenue)')} AS revenue, CAST(COUNT(*) AS BIGINT) AS orders
FROM sales GROUP BY 1 ORDER BY 1"""))(lambda spark, d: A.monthly_sales(star(spark, d)))

register("month_over_month", with_sales(f""", {_MONTHLY}
SELECT month, {R('rev')} AS revenue, {R('LAG(rev) OVER (ORDER BY month)')} AS prev_revenue,
       {_GROWTH.format(c='rev', p='LAG(rev) OVER (ORDER BY month)')} AS growth_pct
FROM monthly ORDER BY month"""))(lambda spark, d: A.month_over_month(star(spark, d)))

register("top_products", with_sales(f"""
SELECT product, {R('rev')} AS revenue, units_sold,
       CAST(ROW_NUMBER() OVER (ORDER BY rev DESC, product) AS INTEGER) AS rank
FROM (SELECT product, SUM(net_revenue) AS rev, CAST(SUM(quantity) AS BIGINT) AS units_sold
      FROM sales GROUP BY product)
ORDER BY rev DESC, product LIMIT 10"""))(lambda spark, d: A.top_products(star(spark, d), 10))

register("region_sales", with_sales(f"""
SELECT region, {R('rev')} AS revenue, orders,
       CASE WHEN SUM(rev) OVER () > 0
            THEN ROUND(CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER () AS DOUBLE) * 100.0, 1)
            ELSE 0.0 END AS percentage
FROM (SELECT region, SUM(net_revenue) AS rev, CAST(COUNT(*) AS BIGINT) AS orders
      FROM sales GROUP BY region)
ORDER BY rev DESC, region"""))(lambda spark, d: A.region_sales(star(spark, d)))

register("category_sales", with_sales(f"""
SELECT category, {R('SUM(net_revenue)')} AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold
FROM sales GROUP BY category ORDER BY SUM(net_revenue) DESC, category"""
                                      ))(lambda spark, d: A.category_sales(star(spark, d)))

register("category_share", with_sales(f"""
SELECT category, {R('rev')} AS revenue,
       CASE WHEN SUM(rev) OVER () > 0
            THEN ROUND(CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER () AS DOUBLE) * 100.0, 1)
            ELSE 0.0 END AS percentage
FROM (SELECT category, SUM(net_revenue) AS rev FROM sales GROUP BY category)
ORDER BY rev DESC, category"""))(lambda spark, d: A.category_share(star(spark, d)))

register("weekly_sales", with_sales(f"""
SELECT CAST(date_trunc('week', order_date) AS DATE) AS week_start,
       {R('SUM(net_revenue)')} AS revenue, CAST(COUNT(*) AS BIGINT) AS orders
FROM sales GROUP BY 1 ORDER BY 1"""))(lambda spark, d: A.weekly_sales(star(spark, d)))

register("daily_revenue", with_sales(f"""
SELECT CAST(order_date AS DATE) AS ds, {R('SUM(net_revenue)')} AS revenue
FROM sales GROUP BY 1 ORDER BY 1"""))(lambda spark, d: A.daily_revenue(star(spark, d)))

# Per-region monthly figures: the same operators with keys.
register("monthly_sales_by_region", with_sales(f"""
SELECT region, strftime(date_trunc('month', order_date), '%Y-%m') AS month,
       {R('SUM(net_revenue)')} AS revenue, CAST(COUNT(*) AS BIGINT) AS orders
FROM sales GROUP BY 1, 2 ORDER BY 1, 2"""))(
    lambda spark, d: A.monthly_sales(star(spark, d), keys=["region"]))

register("top_products_by_category", with_sales(f"""
SELECT category, product, {R('rev')} AS revenue, units_sold, rank FROM (
  SELECT category, product, rev, units_sold,
         CAST(ROW_NUMBER() OVER (PARTITION BY category ORDER BY rev DESC, product) AS INTEGER) AS rank
  FROM (SELECT category, product, SUM(net_revenue) AS rev, CAST(SUM(quantity) AS BIGINT) AS units_sold
        FROM sales GROUP BY 1, 2))
WHERE rank <= 5 ORDER BY category, rank"""))(
    lambda spark, d: A.top_products(star(spark, d), 5, keys=["category"]))


# ---------------------------------------------------------------- C1..C8
def chart_sql(chart: str, base: str, order: str, label: str, series: dict[str, str]) -> str:
    """Positions over ``base`` ordered by ``order``, one row per series."""
    parts = [f"SELECT '{chart}' AS chart, '{name}' AS series, pos, {label} AS label, "
             f"CAST({value} AS DOUBLE) AS value FROM p" for name, value in series.items()]
    return (f"p AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY {order}) - 1 AS INTEGER) AS pos "
            f"FROM ({base}))\n" + "\nUNION ALL\n".join(parts))


_M = ("SELECT strftime(date_trunc('month', order_date), '%Y-%m') AS month, SUM(net_revenue) AS rev, "
      "COUNT(*) AS orders FROM sales GROUP BY 1")
_P8 = ("SELECT product, SUM(net_revenue) AS rev, SUM(quantity) AS units FROM sales GROUP BY 1 "
       "ORDER BY rev DESC, product LIMIT 8")
_C = "SELECT category, SUM(net_revenue) AS rev FROM sales GROUP BY 1"
_RG = "SELECT region, SUM(net_revenue) AS rev, COUNT(*) AS orders FROM sales GROUP BY 1"
_W = ("SELECT CAST(date_trunc('week', order_date) AS DATE) AS wk, SUM(net_revenue) AS rev "
      "FROM sales GROUP BY 1")

_TREND = chart_sql("trend", _M, "month", "month", {"revenue": R("rev"), "orders": "orders"})
_PRODUCTS = chart_sql("products", _P8, "rev DESC, product", "product", {"revenue": R("rev")})
_CATEGORY = chart_sql("category", _C, "rev DESC, category", "category", {"revenue": R("rev")})
_REGION = chart_sql("region", _RG, "rev DESC, region", "region", {"revenue": R("rev"), "orders": "orders"})

register("chart_trend", with_sales(", " + _TREND))(lambda spark, d: C.chart_trend(star(spark, d)))
register("chart_products", with_sales(", " + _PRODUCTS))(lambda spark, d: C.chart_products(star(spark, d)))
register("chart_category", with_sales(", " + _CATEGORY))(lambda spark, d: C.chart_category(star(spark, d)))
register("chart_region", with_sales(", " + _REGION))(lambda spark, d: C.chart_region(star(spark, d)))
register("chart_weekly", with_sales(", " + chart_sql(
    "weekly", _W, "wk", "strftime(wk, '%Y-%m-%d')", {"revenue": R("rev")})))(
    lambda spark, d: C.chart_weekly(star(spark, d)))

_UNITS = f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY units_sold DESC, rnk) - 1 AS INTEGER) AS pos, product, units_sold,
       {R('rev')} AS revenue, rnk AS revenue_rank
FROM (SELECT product, rev, CAST(units AS BIGINT) AS units_sold,
             CAST(ROW_NUMBER() OVER (ORDER BY rev DESC, product) AS INTEGER) AS rnk FROM ({_P8}))"""
register("units_leaders", with_sales(_UNITS))(lambda spark, d: C.units_leaders(star(spark, d), 8))
register("chart_units", with_sales(f"""
SELECT 'units' AS chart, 'units_sold' AS series, pos, product AS label, CAST(units_sold AS DOUBLE) AS value
FROM ({_UNITS})"""))(lambda spark, d: C.chart_units(star(spark, d), 8))


def _bundle_sql() -> str:
    names = ("trend", "products", "category", "region")
    ctes, sels = [], []
    for name, body in zip(names, (_TREND, _PRODUCTS, _CATEGORY, _REGION)):
        ctes.append(f"{name} AS (WITH {body.replace('p AS (', 'p AS (', 1)})")
        sels.append(f"SELECT * FROM {name}")
    return with_sales(", " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(sels))


register("chart_bundle", _bundle_sql())(lambda spark, d: C.chart_bundle(star(spark, d)))
register("chart_payload", None)(lambda spark, d: C.to_payload(C.chart_bundle(star(spark, d))))
register("chart_payload_items", _bundle_sql())(
    lambda spark, d: C.payload_points(C.to_payload(C.chart_bundle(star(spark, d)))))

# ------------------------------------------------------------- A12, A13
register("analytics_payload", None)(lambda spark, d: REP.analytics_payload(star(spark, d)))

register("analytics_payload_items", with_sales(f""", items AS (
  SELECT 'monthly_sales' AS section, strftime(date_trunc('month', order_date), '%Y-%m') AS label, SUM(net_revenue) AS rev,
         COUNT(*) AS amount FROM sales GROUP BY 1, 2
  UNION ALL SELECT 'top_products', product, SUM(net_revenue), SUM(quantity) FROM sales GROUP BY 1, 2
  UNION ALL SELECT 'region_sales', region, SUM(net_revenue), COUNT(*) FROM sales GROUP BY 1, 2
  UNION ALL SELECT 'category_sales', category, SUM(net_revenue), SUM(quantity) FROM sales GROUP BY 1, 2),
placed AS (
  SELECT *, SUM(rev) OVER (PARTITION BY section) AS total, ROW_NUMBER() OVER (
    PARTITION BY section ORDER BY CASE WHEN section = 'monthly_sales' THEN 0 ELSE -rev END, label) - 1 AS pos FROM items)
SELECT section, CAST(pos AS INTEGER) AS pos, label, {R('rev')} AS revenue, CAST(amount AS BIGINT) AS amount,
       CASE WHEN section <> 'region_sales' THEN NULL WHEN total > 0
            THEN ROUND(CAST(rev AS DOUBLE) / CAST(total AS DOUBLE) * 100.0, 1) ELSE 0.0 END AS percentage
FROM placed WHERE section <> 'top_products' OR pos < 10"""))(
    lambda spark, d: REP.payload_items(REP.analytics_payload(star(spark, d))))

register("summary_text", with_sales(f""", {_MONTHLY},
lagged AS (SELECT month, rev, LAG(rev) OVER (ORDER BY month) AS prev,
                  ROW_NUMBER() OVER (ORDER BY month DESC) AS rn FROM monthly),
k AS (
  SELECT COALESCE({R('SUM(net_revenue)')}, 0.0) AS total_revenue,
         CAST(COUNT(*) AS BIGINT) AS total_orders,
         COALESCE(ROUND(CAST(SUM(net_revenue) AS DOUBLE) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE), 2), 0.0) AS aov,
         (SELECT product FROM (SELECT product, SUM(net_revenue) AS rev FROM sales GROUP BY 1)
          ORDER BY rev DESC, product LIMIT 1) AS top_product,
         (SELECT region FROM (SELECT region, SUM(net_revenue) AS rev FROM sales GROUP BY 1)
          ORDER BY rev DESC, region LIMIT 1) AS top_region,
         (SELECT {_GROWTH.format(c='rev', p='prev')} FROM lagged WHERE rn = 1) AS g,
         (SELECT MIN(month) FROM monthly) AS first_m, (SELECT MAX(month) FROM monthly) AS last_m
  FROM sales)
SELECT 'Dataset covers ' || COALESCE(first_m || ' to ' || last_m, 'N/A') || ' with '
       || format('{{:,}}', total_orders) || ' orders generating $' || format('{{:,.2f}}', total_revenue)
       || ' in revenue. Average order value is $' || format('{{:,.2f}}', aov)
       || '. Top product: ' || COALESCE(top_product, 'N/A') || '. Strongest region: '
       || COALESCE(top_region, 'N/A') || '. '
       || CASE WHEN g IS NULL THEN '' ELSE 'Revenue ' || CASE WHEN g > 0 THEN 'grew' ELSE 'declined' END
               || ' ' || printf('%.1f', ROUND(ABS(g), 1)) || '% month-over-month.' END AS summary
FROM k"""))(lambda spark, d: REP.summary_text(star(spark, d)))


# ------------------------------------------------------- P1..P7, Q1..Q8
from ..operators import clean as CL  # noqa: E402
from ..operators import quality as Q  # noqa: E402
from ..sources import csv_files as CSV  # noqa: E402
from ..sources.raw_text import CLEAN_SQL, RAW_SQL, cleaned_sales_text, raw_sales_text  # noqa: E402


def with_clean(body: str) -> str:
    return f"WITH {RAW_SQL},{CLEAN_SQL}\n{body}"


def _normalized(spark, d):
    return CL.normalize_sales(cleaned_sales_text(spark, d), keys=["dataset_id"])


register("normalize_sales", with_clean(r"""
SELECT dataset_id, ts AS order_date,
       CAST(COALESCE(CASE WHEN rev_num IS NOT NULL THEN TRY_CAST(trim(net_revenue) AS DECIMAL(24,4)) END, 0)
            AS DOUBLE) AS net_revenue,
       COALESCE(CASE WHEN regexp_matches(quantity, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$')
                     THEN TRY_CAST(TRUNC(TRY_CAST(trim(quantity) AS DOUBLE)) AS BIGINT) END, 1) AS quantity,
       COALESCE(product, 'Unknown') AS product, COALESCE(category, 'Unknown') AS category,
       COALESCE(region, 'Unknown') AS region, COALESCE(customer_id, 'Unknown') AS customer_id,
       order_id, TRY_CAST(discount AS DOUBLE) AS discount
FROM parsed WHERE ts IS NOT NULL"""))(
    lambda spark, d: _normalized(spark, d).withColumns({
        "net_revenue": F.col("net_revenue").cast("double"),
        # wall-clock time, independent of the reader's time zone
        "order_date": F.col("order_date").cast("timestamp_ntz")}))


def _report_flat(spark, d):
    r = Q.validation_report(cleaned_sales_text(spark, d), keys=["dataset_id"])
    return r.select("dataset_id", "row_count", "column_count", "bad_dates", "bad_revenue", "date_start",
                    "date_end", F.concat_ws(" | ", "errors").alias("errors"), "is_valid")


register("validation_report", with_clean("""
, agg AS (
  SELECT dataset_id, CAST(COUNT(*) AS BIGINT) AS row_count, CAST(9 AS INTEGER) AS column_count,
         CAST(COUNT(*) - COUNT(ts) AS BIGINT) AS bad_dates,
         CAST(COUNT(*) - COUNT(rev_num) AS BIGINT) AS bad_revenue,
         CAST(MIN(ts) AS DATE) AS date_start, CAST(MAX(ts) AS DATE) AS date_end,
         COALESCE(BOOL_AND(rev_num < 0), TRUE) AS all_negative
  FROM parsed GROUP BY dataset_id),
errs AS (
  SELECT *, concat_ws(' | ',
      CASE WHEN row_count < 2 THEN 'The CSV must contain at least 2 data rows.' END,
      CASE WHEN bad_dates > row_count * 0.5 THEN 'Column ''order_date'' has too many unparseable dates ('
           || bad_dates || '/' || row_count || ' rows).' END,
      CASE WHEN bad_revenue > row_count * 0.5 THEN 'Column ''net_revenue'' has too many non-numeric values ('
           || bad_revenue || '/' || row_count || ' rows).'
           WHEN all_negative THEN 'Column ''net_revenue'' contains only negative values.' END) AS errors
  FROM agg)
SELECT dataset_id, row_count, column_count, bad_dates, bad_revenue, date_start, date_end, errors,
       errors = '' AS is_valid
FROM errs""".replace("\n, agg", ", agg", 1)))(_report_flat)

_NC_COLS = ("order_date", "net_revenue", "quantity", "product", "category", "region", "customer_id",
            "order_id", "discount")
register("null_counts", with_clean("\n" + "\nUNION ALL\n".join(
    f"SELECT dataset_id, '{c}' AS \"column\", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls "
    f"FROM clean GROUP BY dataset_id" for c in _NC_COLS)))(
    lambda spark, d: Q.null_counts(cleaned_sales_text(spark, d), keys=["dataset_id"]))

register("text_monthly_sales", with_clean(f"""
SELECT dataset_id, strftime(date_trunc('month', ts), '%Y-%m') AS month,
       {R("SUM(COALESCE(CASE WHEN rev_num IS NOT NULL THEN TRY_CAST(trim(net_revenue) AS DECIMAL(24,4)) END, 0))")}
         AS revenue,
       CAST(COUNT(*) AS BIGINT) AS orders
FROM parsed WHERE ts IS NOT NULL GROUP BY 1, 2"""))(
    lambda spark, d: A.monthly_sales(_normalized(spark, d), keys=["dataset_id"]))


# ------------------------------------------------------------ events
from ..sources.events import EVENTS_SQL, event_sales  # noqa: E402


def with_events(body: str) -> str:
    return f"WITH {EVENTS_SQL}\n{body}"


register("events_weekly_sales", with_events(f"""
SELECT CAST(date_trunc('week', order_date) AS DATE) AS week_start,
       {R('SUM(net_revenue)')} AS revenue, CAST(COUNT(*) AS BIGINT) AS orders
FROM sales GROUP BY 1"""))(lambda spark, d: A.weekly_sales(event_sales(spark, d)))

register("events_daily_revenue", with_events(f"""
SELECT CAST(order_date AS DATE) AS ds, {R('SUM(net_revenue)')} AS revenue
FROM sales GROUP BY 1"""))(lambda spark, d: A.daily_revenue(event_sales(spark, d)))

register("events_kpis_by_type", with_events(f"""
SELECT category, COALESCE({R('SUM(net_revenue)')}, 0.0) AS total_revenue,
       CAST(COUNT(*) AS BIGINT) AS total_orders,
       ROUND(CAST(SUM(net_revenue) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 2) AS avg_order_value,
       CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS unique_customers
FROM sales GROUP BY 1"""))(lambda spark, d: A.kpi_totals(event_sales(spark, d), keys=["category"]))


# ------------------------------------------------------- M1..M5, M7a, M9
from . import features as FT  # noqa: E402
from . import forecast as FC  # noqa: E402


def _feature_sql(source_cte: str, keys: Sequence[str] = ()) -> str:
    """SQL twin of ``build_features`` over ``daily(keys..., ds, y DECIMAL)``."""
    pk = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"OVER ({pk}ORDER BY ds"
    w7 = f"{w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    w30 = f"{w} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
    kc = "".join(f"{k}, " for k in keys)
    two_pi = "(2 * pi())"
    cyc = lambda e: f"(ROUND({e}, 6) + 0.0)"
    return f"""{source_cte},
daily AS (SELECT {kc}CAST(order_date AS DATE) AS ds, SUM(net_revenue) AS y FROM sales GROUP BY ALL),
f AS (
  SELECT {kc}ds, CAST(y AS DOUBLE) AS y,
         CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CAST(day(ds) AS INTEGER) AS day_of_month,
         CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter,
         CAST(dayofyear(ds) AS INTEGER) AS day_of_year,
         CAST(CASE WHEN isodow(ds) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
         CAST(weekofyear(ds) AS INTEGER) AS week_of_year,
         CAST(ROW_NUMBER() {w}) - 1 AS INTEGER) AS trend,
         LAG(CAST(y AS DOUBLE), 1) {w}) AS lag_1d, LAG(CAST(y AS DOUBLE), 7) {w}) AS lag_7d,
         LAG(CAST(y AS DOUBLE), 14) {w}) AS lag_14d, LAG(CAST(y AS DOUBLE), 30) {w}) AS lag_30d,
         CASE WHEN COUNT(y) {w7} >= 1 THEN CAST(SUM(y) {w7} AS DOUBLE) / COUNT(y) {w7} END AS rolling_mean_7d,
         CASE WHEN COUNT(y) {w30} >= 7 THEN CAST(SUM(y) {w30} AS DOUBLE) / COUNT(y) {w30} END
           AS rolling_mean_30d,
         ROUND(COALESCE(STDDEV_SAMP(CAST(y AS DOUBLE)) {w7}, 0.0), 4) + 0.0 AS rolling_std_7d
  FROM daily),
features AS (
  SELECT *, {cyc(f'sin({two_pi} * month / 12)')} AS month_sin, {cyc(f'cos({two_pi} * month / 12)')} AS month_cos,
         {cyc(f'sin({two_pi} * day_of_week / 7)')} AS dow_sin, {cyc(f'cos({two_pi} * day_of_week / 7)')} AS dow_cos
  FROM f)"""


_FCOLS = ", ".join(FT.FEATURES)
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FT.FEATURES)


def _split_sql(keys: Sequence[str] = ()) -> str:
    pk = f"PARTITION BY {', '.join(keys)}" if keys else ""
    kc = "".join(f"{k}, " for k in keys)
    return f""",
complete AS (SELECT *, COUNT(*) OVER ({pk}) AS n_rows FROM features WHERE {_COMPLETE}),
rows_split AS (
  SELECT {kc}ds, y, {_FCOLS},
         CASE WHEN ROW_NUMBER() OVER ({pk} ORDER BY ds) <= FLOOR(n_rows * 0.8) THEN 'train' ELSE 'test' END AS split
  FROM complete WHERE n_rows >= 30)"""


def _star_series(spark, d, keys=()):
    return FT.daily_series(star(spark, d), keys)


register("features", with_sales(", " + _feature_sql("", ()).lstrip(",") + f"""
SELECT ds, y, {_FCOLS} FROM features"""))(lambda spark, d: FT.build_features(_star_series(spark, d)))

register("features_by_region", with_sales(", " + _feature_sql("", ("region",)).lstrip(",") + f"""
SELECT region, ds, y, {_FCOLS} FROM features"""))(
    lambda spark, d: FT.build_features(_star_series(spark, d, ["region"]), ["region"]))

register("training_rows", with_sales(", " + _feature_sql("", ()).lstrip(",") + _split_sql() + f"""
SELECT * FROM rows_split"""))(lambda spark, d: FT.training_rows(_star_series(spark, d)))

register("training_status_events", with_events(", " + _feature_sql("", ()).lstrip(",") + f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_days, CAST(COUNT_IF({_COMPLETE}) AS BIGINT) AS n_complete,
       COUNT(*) >= 30 AND COUNT_IF({_COMPLETE}) >= 30 AS eligible,
       CASE WHEN COUNT(*) < 30 THEN 'fewer than 30 days with sales'
            WHEN COUNT_IF({_COMPLETE}) < 30 THEN 'fewer than 30 complete feature rows' END AS reason
FROM features"""))(lambda spark, d: FT.training_status(FT.daily_series(event_sales(spark, d))))

_NAIVE_METRICS = f""",
test AS (SELECT y, GREATEST(lag_7d, 0.0) AS p FROM rows_split WHERE split = 'test'),
m AS (SELECT AVG(ABS(y - p)) AS mae, SQRT(AVG((y - p) * (y - p))) AS rmse,
             SUM((y - p) * (y - p)) AS ssr, COUNT(*) AS n FROM test),
sst AS (SELECT SUM((y - (SELECT AVG(y) FROM test)) * (y - (SELECT AVG(y) FROM test))) AS sst FROM test)"""

register("naive_metrics", with_sales(", " + _feature_sql("", ()).lstrip(",") + _split_sql() + _NAIVE_METRICS + """
SELECT ROUND(mae, 2) AS mae, ROUND(rmse, 2) AS rmse,
       ROUND(CASE WHEN sst > 0 THEN 1.0 - ssr / sst ELSE 0.0 END, 4) AS r2_score,
       CAST(n AS BIGINT) AS test_samples,
       (SELECT CAST(COUNT_IF(split = 'train') AS BIGINT) FROM rows_split) AS training_samples
FROM m, sst"""))(lambda spark, d: FC.naive_metrics(_star_series(spark, d)))


def _naive_forecast(spark, d):
    s = _star_series(spark, d)
    mae = FC.naive_metrics(s).select("mae")
    pts = FC.seasonal_naive(s).crossJoin(mae)
    return FC.forecast_interval(pts, F.col("mae")).drop("mae")


_NAIVE_FORECAST = f""",
last7 AS (SELECT ds, CAST(y AS DOUBLE) AS y, ROW_NUMBER() OVER (ORDER BY ds DESC) AS r FROM daily),
steps AS (SELECT CAST(range AS INTEGER) AS step FROM range(30)),
pts AS (SELECT step, CAST((SELECT MAX(ds) FROM daily) + INTERVAL (step + 1) DAY AS DATE) AS ds, l.y AS predicted
        FROM steps JOIN last7 l ON l.r = 7 - step % 7),
mae AS (SELECT mae FROM (SELECT AVG(ABS(y - GREATEST(lag_7d, 0.0))) AS mae_raw FROM rows_split
        WHERE split = 'test') t, LATERAL (SELECT ROUND(mae_raw, 2) AS mae)),
fc AS (SELECT step, ds, ROUND(predicted, 2) AS predicted_revenue,
              ROUND(GREATEST(predicted - mae * (1.5 + step * 0.02), 0.0), 2) AS lower_bound,
              ROUND(predicted + mae * (1.5 + step * 0.02), 2) AS upper_bound
       FROM pts, mae)"""

register("seasonal_naive_forecast", with_sales(", " + _feature_sql("", ()).lstrip(",") + _split_sql()
                                                + _NAIVE_FORECAST + """
SELECT * FROM fc"""))(_naive_forecast)

register("forecast_total_naive", with_sales(", " + _feature_sql("", ()).lstrip(",") + _split_sql()
                                             + _NAIVE_FORECAST + """
SELECT ROUND(SUM(predicted_revenue), 2) AS forecast_total FROM fc"""))(
    lambda spark, d: A.forecast_total(_naive_forecast(spark, d)))


# ------------------------------------------- M6, M8, M11, M12, C7, C9
def _forecast(spark, d):
    """The daily series of a folder, and the forecast trained on it."""
    s = FT.daily_series(star(spark, d))
    return s, FC.train_and_forecast(s)


register("forecast", None)(lambda spark, d: _forecast(spark, d)[1].points)


def _forecast_by_region(spark, d):
    """Five region series in one pooled model and one recursive loop."""
    s = FT.daily_series(star(spark, d), ["region"])
    return FC.train_and_forecast(s, ["region"]).points


register("forecast_by_region", None)(_forecast_by_region)
register("forecast_metrics", None)(lambda spark, d: _forecast(spark, d)[1].metrics)


def _forecast_chart(spark, d):
    series, result = _forecast(spark, d)  # one training
    return C.chart_forecast(series, result.points)


register("chart_forecast", None)(_forecast_chart)
register("forecast_boundary", None)(lambda spark, d: C.forecast_boundary(_forecast_chart(spark, d)))


def _naive_chart(spark, d):
    return C.chart_forecast(_star_series(spark, d), _naive_forecast(spark, d))


register("chart_naive_forecast", with_sales(", " + _feature_sql("", ()).lstrip(",") + _split_sql()
                                             + _NAIVE_FORECAST + """,
hist AS (SELECT ds, y, CAST(ROW_NUMBER() OVER (ORDER BY ds) - 1 AS INTEGER) AS pos
         FROM (SELECT * FROM daily ORDER BY ds DESC LIMIT 60)),
n AS (SELECT CAST(COUNT(*) AS INTEGER) AS n FROM hist)
SELECT 'forecast' AS chart, 'history' AS series, pos, strftime(ds, '%Y-%m-%d') AS label,
       ROUND(CAST(y AS DOUBLE), 2) AS value FROM hist
UNION ALL SELECT 'forecast', 'predicted', n + step, strftime(ds, '%Y-%m-%d'), predicted_revenue FROM fc, n
UNION ALL SELECT 'forecast', 'upper', n + step, strftime(ds, '%Y-%m-%d'), upper_bound FROM fc, n
UNION ALL SELECT 'forecast', 'lower', n + step, strftime(ds, '%Y-%m-%d'), lower_bound FROM fc, n"""))(_naive_chart)


# ------------------------------------------------ W9, C9, P3, Q10, S9
register("recent_history", with_sales(f"""
SELECT ds, {R('y')} AS y FROM (
  SELECT CAST(order_date AS DATE) AS ds, SUM(net_revenue) AS y FROM sales GROUP BY 1)
ORDER BY ds DESC LIMIT 60"""))(lambda spark, d: FT.recent_history(_star_series(spark, d), days=60)
                              .select("ds", A.money_out("y").alias("y")))

register("forecast_boundary_naive", with_sales(", " + _feature_sql("", ()).lstrip(",") + _split_sql()
                                                + _NAIVE_FORECAST + """,
n AS (SELECT CAST(LEAST(COUNT(*), 60) AS INTEGER) AS n FROM daily)
SELECT (SELECT n FROM n) AS first_forecast_pos, MIN(lower_bound) AS range_low, MAX(upper_bound) AS range_high,
       '$' || format('{:,.0f}', MIN(lower_bound)) || ' - $' || format('{:,.0f}', MAX(upper_bound)) AS range_text
FROM fc"""))(lambda spark, d: C.forecast_boundary(_naive_chart(spark, d)))

register("sales_time_parts", with_clean("""
SELECT dataset_id, ts AS order_date, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       strftime(ts, '%Y-%m') AS year_month, CAST(weekofyear(ts) AS INTEGER) AS week
FROM parsed WHERE ts IS NOT NULL"""))(
    lambda spark, d: CL.time_parts(_normalized(spark, d)).select(
        "dataset_id", F.col("order_date").cast("timestamp_ntz").alias("order_date"),
        "year", "month", "year_month", "week"))


def _messages(spark, d):
    r = Q.validation_report(cleaned_sales_text(spark, d), keys=["dataset_id"])
    return r.where("is_valid").select("dataset_id", Q.ingest_message(F.col("dataset_id"), F.col("row_count"))
                                      .alias("message"))


_MESSAGES_SQL = (
    "SELECT dataset_id, 'Successfully uploaded ''' || dataset_id || ''' — ' || format('{:,}', COUNT(*))\n"
    "       || ' rows ready for analysis.' AS message\n"
    "FROM parsed GROUP BY dataset_id\n"
    "HAVING NOT (COUNT(*) - COUNT(rev_num) > COUNT(*) * 0.5) AND NOT (COUNT(*) - COUNT(ts) > COUNT(*) * 0.5)\n"
    "   AND NOT COALESCE(BOOL_AND(rev_num < 0), TRUE) AND COUNT(*) >= 2")
register("ingest_messages", with_clean(_MESSAGES_SQL))(_messages)

_DUP_COLS = ("order_date", "net_revenue", "quantity", "product", "category", "region", "customer_id",
             "order_id", "discount")
_DUP_KEY = ", ".join(f"COALESCE({c}, chr(30))" for c in _DUP_COLS)
register("duplicate_rows", f"WITH {RAW_SQL}\n"
         f"SELECT md5(concat_ws(chr(31), {_DUP_KEY})) AS row_md5, CAST(COUNT(*) AS BIGINT) AS n\n"
         "FROM raw GROUP BY 1 HAVING COUNT(*) > 1")(
    lambda spark, d: CSV.duplicate_rows(raw_sales_text(spark, d), list(_DUP_COLS)))


register("seasonal_naive_by_region", with_sales(""",
daily AS (SELECT region, CAST(order_date AS DATE) AS ds, SUM(net_revenue) AS y FROM sales GROUP BY 1, 2),
last7 AS (SELECT region, ds, y, ROW_NUMBER() OVER (PARTITION BY region ORDER BY ds DESC) AS r FROM daily),
ends AS (SELECT region, MAX(ds) AS e FROM daily GROUP BY region),
steps AS (SELECT CAST(range AS INTEGER) AS step FROM range(30))
SELECT e.region, s.step, CAST(e.e + INTERVAL (s.step + 1) DAY AS DATE) AS ds,
       ROUND(CAST(l.y AS DOUBLE), 2) AS predicted
FROM ends e CROSS JOIN steps s JOIN last7 l ON l.region = e.region AND l.r = 7 - s.step % 7"""))(
    lambda spark, d: FC.seasonal_naive(_star_series(spark, d, ["region"]), ["region"])
    .withColumn("predicted", F.round("predicted", 2)))


register("naive_metrics_by_region", with_sales(", " + _feature_sql("", ("region",)).lstrip(",")
                                                + _split_sql(("region",)) + """,
test AS (SELECT region, y, GREATEST(lag_7d, 0.0) AS p FROM rows_split WHERE split = 'test'),
means AS (SELECT region, AVG(y) AS ybar FROM test GROUP BY region),
m AS (SELECT t.region, AVG(ABS(y - p)) AS mae, SQRT(AVG((y - p) * (y - p))) AS rmse,
             SUM((y - p) * (y - p)) AS ssr, SUM((y - ybar) * (y - ybar)) AS sst, COUNT(*) AS n
      FROM test t JOIN means USING (region) GROUP BY t.region),
tr AS (SELECT region, COUNT_IF(split = 'train') AS training_samples FROM rows_split GROUP BY region)
SELECT region, ROUND(mae, 2) AS mae, ROUND(rmse, 2) AS rmse,
       ROUND(CASE WHEN sst > 0 THEN 1.0 - ssr / sst ELSE 0.0 END, 4) AS r2_score,
       CAST(n AS BIGINT) AS test_samples, CAST(training_samples AS BIGINT) AS training_samples
FROM m JOIN tr USING (region)"""))(
    lambda spark, d: FC.naive_metrics(_star_series(spark, d, ["region"]), ["region"]))


# ------------------------------------------ W10, H1, H2, H5, T3, M4, M8, Q
from ..operators import headers as HD  # noqa: E402
from ..sources import stores as ST  # noqa: E402
from ..sources.star import read_table  # noqa: E402

register("latest_event_per_user", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events)
WHERE r = 1""")(lambda spark, d: ST.latest_per_key(
    read_table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                                          "event_type", "value"), ["user_id"], ["ts", "event_id"]))

register("describe_schema", """
SELECT pos, name, dtype, (SELECT COUNT(*) FROM orders) AS row_count, CAST(6 AS INTEGER) AS column_count
FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'),
             (3, 'o_totalprice', 'double'), (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string'))
  AS t(pos, name, dtype)""")(lambda spark, d: HD.describe_schema(read_table(spark, d, "orders").withColumn(
    "o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))))

register("units_leaders_by_units", with_sales(f"""
SELECT CAST(rnk - 1 AS INTEGER) AS pos, product, units AS units_sold, {R('rev')} AS revenue, rnk AS revenue_rank
FROM (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY units DESC, rev DESC, product) AS INTEGER) AS rnk
      FROM (SELECT product, SUM(net_revenue) AS rev, CAST(SUM(quantity) AS BIGINT) AS units FROM sales GROUP BY 1))
WHERE rnk <= 8"""))(lambda spark, d: C.units_leaders(star(spark, d), 8, by="units"))

register("training_status_by_region", with_sales(", " + _feature_sql("", ("region",)).lstrip(",") + f"""
SELECT region, CAST(COUNT(*) AS BIGINT) AS n_days, CAST(COUNT_IF({_COMPLETE}) AS BIGINT) AS n_complete,
       COUNT(*) >= 30 AND COUNT_IF({_COMPLETE}) >= 30 AS eligible,
       CASE WHEN COUNT(*) < 30 THEN 'fewer than 30 days with sales'
            WHEN COUNT_IF({_COMPLETE}) < 30 THEN 'fewer than 30 complete feature rows' END AS reason
FROM features GROUP BY region"""))(
    lambda spark, d: FT.training_status(_star_series(spark, d, ["region"]), ["region"]))

_MEAN7 = "(0.0::DOUBLE + " + " + ".join(f"h[-{i}]" for i in range(7, 0, -1)) + ") / 7.0::DOUBLE"
register("blend_forecast_by_region", with_sales(f""",
daily AS (SELECT region, CAST(order_date AS DATE) AS ds, SUM(net_revenue) AS y FROM sales GROUP BY 1, 2),
r(region, e, step, h) AS (
  SELECT region, MAX(ds), 0, list(CAST(y AS DOUBLE) ORDER BY ds)[-30:] FROM daily GROUP BY region
  UNION ALL
  SELECT region, e, step + 1, list_append(h, GREATEST(0.5::DOUBLE * h[-1] + 0.3::DOUBLE * h[-7]
                                                      + 0.2::DOUBLE * ({_MEAN7}), 0.0::DOUBLE))
  FROM r WHERE step < 30)
SELECT region, CAST(i AS INTEGER) AS step, CAST(e + INTERVAL (i + 1) DAY AS DATE) AS ds,
       ROUND(h[len(h) - 29 + i], 2) AS predicted
FROM r, range(30) AS t(i) WHERE step = 30""").replace("WITH", "WITH RECURSIVE", 1))(
    lambda spark, d: FC.forecast_by_rule(_star_series(spark, d, ["region"]), FC.blend_rule(), ["region"])
    .withColumn("predicted", F.round("predicted", 2)))

register("forecast_shape_by_region", with_sales(", " + _feature_sql("", ("region",)).lstrip(",") + f""",
able AS (SELECT region, MAX(ds) AS e FROM features GROUP BY region
         HAVING COUNT(*) >= 30 AND COUNT_IF({_COMPLETE}) >= 30)
SELECT region, CAST(i AS INTEGER) AS step, CAST(e + INTERVAL (i + 1) DAY AS DATE) AS ds, TRUE AS bounds_hold
FROM able, range(30) AS t(i)"""))(lambda spark, d: _forecast_by_region(spark, d).select(
    "region", "step", "ds", ((F.col("lower_bound") >= 0) & (F.col("lower_bound") <= F.col("predicted_revenue"))
                             & (F.col("predicted_revenue") <= F.col("upper_bound"))).alias("bounds_hold")))

# Header rows of one export per order priority; the layout depends on the priority's first character.
_LAYOUTS = {
    "1": ["Order Date", "Sales", "Sales", "Product-Name", "QTY", "Zone"],
    "2": ["id", " sale_date ", "Revenue", "amount", "Item", "Type"],
    "3": ["date", "Date", "TOTAL PRICE", "total-price", "notes"],
    "4": ["transaction_date", "units", "client_id", "Discount Pct"],
    "5": ["purchase-date", "price", "location", "territory", "user_id", "order"],
}


def _export_headers(spark, d):
    sets = read_table(spark, d, "orders").where(F.col("o_orderpriority").isNotNull()).select(
        F.col("o_orderpriority").alias("dataset_id")).distinct()
    layout = F.coalesce(*[F.when(F.col("dataset_id").startswith(k), F.array(*[F.lit(h) for h in hs]))
                          for k, hs in _LAYOUTS.items()])
    return sets.select("dataset_id", F.posexplode(layout).alias("pos", "header"))


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


register("header_mapping", f"""
WITH s AS (SELECT dataset_id, CASE {' '.join(f"WHEN starts_with(dataset_id, '{k}') THEN {_list_sql(hs)}"
                                             for k, hs in _LAYOUTS.items())} END AS l
           FROM (SELECT DISTINCT o_orderpriority AS dataset_id FROM orders WHERE o_orderpriority IS NOT NULL)),
h AS (SELECT dataset_id, header, MIN(pos) AS pos
      FROM (SELECT dataset_id, unnest(l) AS header, unnest(range(len(l))) AS pos FROM s) GROUP BY 1, 2),
n AS (SELECT *, replace(replace(lower(trim(header)), '-', '_'), ' ', '_') AS norm FROM h),
last AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset_id, norm ORDER BY pos DESC) AS r FROM n),
a AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{a.replace(' ', '_')}', {i})" for c, al in HD.ALL_ALIASES.items()
                                        for i, a in enumerate(al))}) AS t(canonical, norm, prio)),
b AS (SELECT dataset_id, canonical, CAST(pos AS INTEGER) AS pos, header,
             ROW_NUMBER() OVER (PARTITION BY dataset_id, canonical ORDER BY prio) AS r
      FROM last JOIN a USING (norm) WHERE last.r = 1)
SELECT dataset_id, canonical, pos, header FROM b WHERE r = 1""")(
    lambda spark, d: HD.mapping_table(_export_headers(spark, d)))


def _order_datasets(spark, d):
    """One dataset per order (customers' amounts whose id ends in 7 are negative), and an empty one per customer."""
    raw = raw_sales_text(spark, d)
    negative = F.col("customer_id").endswith("7") & ~F.col("net_revenue").startswith("-")
    raw = raw.withColumns({"dataset_id": F.col("order_id"), "net_revenue": F.when(
        negative, F.concat(F.lit("-"), F.col("net_revenue"))).otherwise(F.col("net_revenue"))})
    rows = raw.select("dataset_id", *[CSV.clean_text(c).alias(c) for c in raw.columns if c != "dataset_id"])
    every = F.array(*[F.lit(c) for c in HD.CANONICAL])
    heads = [F.lit("Order Date").alias("date_header"), F.lit("Amount").alias("revenue_header")]
    key = F.col("o_orderkey")
    sets = read_table(spark, d, "orders").select(
        key.cast("string").alias("dataset_id"), (9 + key % 10 * 12).cast("int").alias("column_count"), *heads,
        F.when(key % 11 == 0, F.array_remove(every, "net_revenue")).otherwise(every).alias("mapped"))
    empty = read_table(spark, d, "customer").select(
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("dataset_id"),
        F.lit(9).alias("column_count"), *heads, every.alias("mapped"))
    return Q.validation_report(rows, sets.unionByName(empty)).select(
        "dataset_id", "row_count", "column_count", "bad_dates", "bad_revenue", "date_start", "date_end",
        F.concat_ws(",", "missing_required").alias("missing"), F.concat_ws(" | ", "errors").alias("errors"), "is_valid")


_BY_ORDER_RAW = RAW_SQL.replace("raw AS (", "all_raw AS (", 1) + """,
raw AS (
  SELECT order_id AS dataset_id, order_date,
         CASE WHEN customer_id LIKE '%7' AND net_revenue NOT LIKE '-%' THEN '-' || net_revenue ELSE net_revenue END
           AS net_revenue, quantity, product, category, region, customer_id, order_id, discount
  FROM all_raw)"""
register("validation_by_order", f"WITH {_BY_ORDER_RAW},{CLEAN_SQL}" + """,
agg AS (
  SELECT dataset_id, COUNT(*) AS n, COUNT(*) - COUNT(ts) AS bd, COUNT(*) - COUNT(rev_num) AS br,
         CAST(MIN(ts) AS DATE) AS date_start, CAST(MAX(ts) AS DATE) AS date_end,
         COALESCE(BOOL_AND(rev_num < 0), TRUE) AS neg FROM parsed GROUP BY dataset_id),
sets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS dataset_id, CAST(9 + o_orderkey % 10 * 12 AS INTEGER) AS column_count,
         o_orderkey % 11 <> 0 AS has_rev FROM orders
  UNION ALL SELECT 'customer ' || c_custkey, 9, TRUE FROM customer),
j AS (SELECT s.*, date_start, date_end, COALESCE(n, 0) AS n, COALESCE(bd, 0) AS bd, COALESCE(br, 0) AS br, neg
      FROM sets s LEFT JOIN agg USING (dataset_id)),
m AS (
  SELECT *, CASE WHEN n = 0 THEN 'The CSV file contains no data rows.' ELSE concat_ws(' | ',
      CASE WHEN n < 2 THEN 'The CSV must contain at least 2 data rows.' END,
      CASE WHEN column_count > 100 THEN 'Too many columns (' || column_count || '). Maximum is 100.' END,
      CASE WHEN bd > n * 0.5 THEN 'Column ''Order Date'' has too many unparseable dates (' || bd || '/' || n || ' rows).' END,
      CASE WHEN NOT has_rev THEN NULL
           WHEN br > n * 0.5 THEN 'Column ''Amount'' has too many non-numeric values (' || br || '/' || n || ' rows).'
           WHEN neg THEN 'Column ''Amount'' contains only negative values.' END) END AS errors
  FROM j)
SELECT dataset_id, CAST(n AS BIGINT) AS row_count, column_count, CAST(bd AS BIGINT) AS bad_dates,
       CAST(br AS BIGINT) AS bad_revenue, date_start, date_end,
       CASE WHEN has_rev THEN '' ELSE 'net_revenue' END AS missing, errors, errors = '' AND has_rev AS is_valid
FROM m""")(_order_datasets)


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}

# Further queries register themselves.
from . import catalog_ingest, catalog_linear  # noqa: E402, F401
