"""Registered queries of the per-series linear models, with DuckDB SQL that solves the same normal equations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import features as FT
from . import linear as LIN
from .catalog import QUERIES, _feature_sql, _split_sql, _star_series, register, with_sales
from .forecast_store import forecast_many, series_fingerprints

_K = len(FT.FEATURES)


def _models_sql() -> str:
    """CTEs up to ``model(region, i, beta, coefficient)`` and ``intercept(region, b0)``: sums of products, then one sweep a feature."""
    names = ", ".join(f"CAST({c} AS DOUBLE)" for c in (*FT.FEATURES, "y"))
    out = f""",
cells AS (SELECT region, ds, unnest(range(1, {_K + 2})) AS i, unnest([{names}]) AS v FROM rows_split WHERE split = 'train'),
sums AS MATERIALIZED (SELECT region, i, COUNT(*) AS n, SUM(v) AS s, SUM(v * v) AS q FROM cells GROUP BY region, i),
scale AS MATERIALIZED (SELECT region, i, n, s, CASE WHEN q - s * s / n > 1e-12 * q THEN SQRT(q - s * s / n) ELSE 0 END AS d FROM sums),
products AS (SELECT a.region, a.i, b.i AS j, SUM(a.v * b.v) AS p FROM cells a JOIN cells b USING (region, ds) WHERE a.i <= {_K} GROUP BY ALL),
w0 AS MATERIALIZED (
  SELECT p.region, p.i, p.j, CASE WHEN a.d * b.d > 0 THEN (p - a.s * b.s / a.n) / (a.d * b.d) ELSE 0 END AS v
  FROM products p JOIN scale a ON a.region = p.region AND a.i = p.i JOIN scale b ON b.region = p.region AND b.i = p.j)"""
    for k in range(1, _K + 1):
        w = f"w{k - 1}"
        out += f""",
w{k} AS MATERIALIZED (
  SELECT t.region, t.i, t.j, CASE WHEN p.v <= {LIN.DEPENDENT} THEN t.v WHEN t.i = {k} THEN t.v / p.v ELSE t.v - c.v * r.v / p.v END AS v
  FROM {w} t JOIN {w} p ON p.region = t.region AND p.i = {k} AND p.j = {k}
  JOIN {w} c ON c.region = t.region AND c.i = t.i AND c.j = {k}
  JOIN {w} r ON r.region = t.region AND r.i = {k} AND r.j = t.j)"""
    return out + f""",
model AS MATERIALIZED (
  SELECT x.region, x.i, CASE WHEN d.v > 0.5 THEN x.v ELSE 0 END AS beta,
         CASE WHEN d.v > 0.5 AND a.d > 0 THEN x.v * y.d / a.d ELSE 0 END AS coefficient, a.s / a.n AS mean, y.s / y.n AS ybar, a.n
  FROM w{_K} x JOIN w{_K} d ON d.region = x.region AND d.i = x.i AND d.j = x.i
  JOIN scale a ON a.region = x.region AND a.i = x.i JOIN scale y ON y.region = x.region AND y.i = {_K + 1}
  WHERE x.j = {_K + 1}),
intercept AS MATERIALIZED (SELECT region, MAX(ybar) - SUM(coefficient * mean) AS b0 FROM model GROUP BY region)"""


_BASE = ", " + _feature_sql("", ("region",)).lstrip(",") + _split_sql(("region",)) + _models_sql()
_NAMES = ", ".join(f"'{c}'" for c in FT.FEATURES)


def _fit(spark, d):
    return LIN.fit_series(_star_series(spark, d, ["region"]), ["region"])


def _coefficients(spark, d):
    models = _fit(spark, d)[1].select("region", "n", F.posexplode("betas").alias("i", "beta"))
    name = F.get(F.array(*map(F.lit, FT.FEATURES)), F.col("i"))
    return models.select("region", name.alias("feature"), (F.round("beta", 4) + F.lit(0.0)).alias("beta"), F.col("n").alias("training_samples"))


register("fit_linear_by_region", with_sales(_BASE + f"""
SELECT region, list_extract([{_NAMES}], i) AS feature, ROUND(beta, 4) + 0.0 AS beta, CAST(n AS BIGINT) AS training_samples
FROM model"""))(_coefficients)


def _metrics(spark, d):
    return LIN.linear_metrics(*_fit(spark, d), ["region"])


register("linear_metrics_by_region", with_sales(_BASE + f""",
test AS (
  SELECT region, y, GREATEST(MAX(b0) + SUM(coefficient * v), 0) AS p
  FROM (SELECT region, ds, y, unnest(range(1, {_K + 1})) AS i, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in FT.FEATURES)}]) AS v
        FROM rows_split WHERE split = 'test') JOIN model USING (region, i) JOIN intercept USING (region) GROUP BY region, ds, y),
means AS (SELECT region, AVG(y) AS ybar FROM test GROUP BY region),
m AS (SELECT t.region, AVG(ABS(y - p)) AS mae, SQRT(AVG((y - p) * (y - p))) AS rmse,
             SUM((y - p) * (y - p)) AS ssr, SUM((y - ybar) * (y - ybar)) AS sst, COUNT(*) AS n
      FROM test t JOIN means USING (region) GROUP BY t.region),
tr AS (SELECT region, COUNT_IF(split = 'train') AS training_samples FROM rows_split GROUP BY region)
SELECT region, ROUND(mae, 2) AS mae, ROUND(rmse, 2) AS rmse,
       ROUND(CASE WHEN sst > 0 THEN 1.0 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END, 4) AS r2_score,
       CAST(n AS BIGINT) AS test_samples, CAST(training_samples AS BIGINT) AS training_samples
FROM m JOIN tr USING (region)"""))(_metrics)

_DS = "CAST(e + INTERVAL (step + 1) DAY AS DATE)"
_DOW = f"(isodow({_DS}) - 1)"
_TWO_PI = "(2 * pi())"
#: The features of the next day from the list of values ``h`` and the last day ``e``, in model order.
_NEXT = [_DOW, f"day({_DS})", f"month({_DS})", f"quarter({_DS})", f"dayofyear({_DS})", f"CASE WHEN {_DOW} >= 5 THEN 1 ELSE 0 END",
         f"weekofyear({_DS})", "(n + step)", "h[-1]", "h[-7]", "h[-14]", "h[-30]", "list_sum(h[-7:]) / 7", "list_sum(h[-30:]) / 30",
         "ROUND(list_aggregate(h[-7:], 'stddev_samp'), 4)", f"ROUND(sin({_TWO_PI} * month({_DS}) / 12), 6)", f"ROUND(cos({_TWO_PI} * month({_DS}) / 12), 6)",
         f"ROUND(sin({_TWO_PI} * {_DOW} / 7), 6)", f"ROUND(cos({_TWO_PI} * {_DOW} / 7), 6)"]
_STEP = " + ".join(["b0", *(f"c[{i + 1}] * ({x})" for i, x in enumerate(_NEXT))])


def _forecast(spark, d):
    keys = ["region"]
    series = _star_series(spark, d, keys)
    points = LIN.folded_forecast(series, LIN.fit_series(series, keys)[1], keys)
    return points.withColumn("predicted", F.round("predicted", 2))


register("forecast_linear_by_region", with_sales(_BASE + f""",
r(region, e, n, step, h, c, b0) AS (
  SELECT region, MAX(ds), COUNT(*), 0, list(CAST(y AS DOUBLE) ORDER BY ds)[-30:], ANY_VALUE(c), ANY_VALUE(b0)
  FROM daily JOIN (SELECT region, list(coefficient ORDER BY i) AS c FROM model GROUP BY region) USING (region) JOIN intercept USING (region)
  GROUP BY region
  UNION ALL
  SELECT region, e, n, step + 1, list_append(h, GREATEST({_STEP}, 0)), c, b0 FROM r WHERE step < 30)
SELECT region, CAST(i AS INTEGER) AS step, CAST(e + INTERVAL (i + 1) DAY AS DATE) AS ds, ROUND(h[len(h) - 29 + i], 2) AS predicted
FROM r, range(30) AS t(i) WHERE step = 30""").replace("WITH", "WITH RECURSIVE", 1))(_forecast)


# ------------------------------------------------------------ M10 S12 S13
def _stored_forecast(spark, d):
    """Region forecasts through the store: trained once, then read back."""
    keys = ["region"]
    series = _star_series(spark, d, keys)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forecasts/{uuid.uuid4().hex}"
    forecast_many(series, keys, path)
    return forecast_many(series, keys, path)[0].select("region", "step", "ds", "predicted_revenue")


register("stored_forecast_by_region", QUERIES["forecast_linear_by_region"][1].replace("AS predicted\n", "AS predicted_revenue\n"))(_stored_forecast)

register("series_fingerprints", with_sales("""
, daily AS (SELECT region, CAST(order_date AS DATE) AS ds, SUM(net_revenue) AS y FROM sales GROUP BY ALL)
SELECT region, COUNT(*) AS n_days,
       CAST(SUM(CAST('0x' || substr(md5(strftime(ds, '%Y-%m-%d') || ' ' || CAST(y AS VARCHAR)), 1, 15) AS BIGINT)) AS VARCHAR) AS print
FROM daily GROUP BY region"""))(lambda spark, d: series_fingerprints(_star_series(spark, d, ["region"]), ["region"]))
