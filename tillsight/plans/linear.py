"""Ordinary least squares per series, without Spark ML and without the driver.

One aggregate per series key gathers the sums and the sums of products of
all features and the target (pre-aggregated in every task).  The normal
equations of the standardised features are solved inside one projection: a
fold over the features sweeps the matrix, which is one array column.  A
feature that is constant, or that the features before it determine, gets
the coefficient 0.

A model is two columns (``coefficients``, ``intercept``), so it is applied,
scored and joined like any other data, and a whole recursive forecast is one
projection over one row per series: no loop, no checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip_nonnegative
from .features import FEATURES, training_rows
from .forecast import HORIZON, forecast_interval, initial_state, regression_metrics, split_counts, step_features

#: A standardised feature adds less than this share of new variance: it depends on those before it.
DEPENDENT = 1e-9


def solve(matrix: Column, n: int) -> Column:
    """Solution of ``n`` equations given as a flat array of rows of ``n + 1`` values, by sweeps without exchanges."""
    m = n + 1

    def sweep(a: Column, k: Column) -> Column:
        pivot = F.get(a, k * m + k)
        row = lambda p: ((p - p % m) / m).cast("int")
        swept = F.transform(a, lambda x, p: F.when(row(p) == k, x / pivot).otherwise(
            x - F.get(a, row(p) * m + k) * F.get(a, k * m + p % m) / pivot))
        return F.when(pivot > DEPENDENT, swept).otherwise(a)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, sweep)
    # A feature that was swept has 1 on the diagonal.
    return F.get(F.transform(F.array(done), lambda a: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.get(a, k * m + k) > 0.5, F.get(a, k * m + n)).otherwise(F.lit(0.0)))), 0)


def fit_linear(rows: DataFrame, keys: Sequence[str] = (), features: Sequence[str] = FEATURES, label: str = "y") -> DataFrame:
    """``(keys..., n, betas, coefficients, intercept)``: one model per key over ``rows``.

    ``betas`` are the coefficients in standard deviations of the features and of the label.
    """
    names = [*features, label]
    k = len(features)
    x = {c: F.col(c).cast("double") for c in names}
    sums = [F.sum(x[c]).alias(f"s{i}") for i, c in enumerate(names)]
    products = [F.sum(x[a] * x[names[j]]).alias(f"p{i}_{j}") for i, a in enumerate(names) for j in range(i, k + 1)]
    g = rows.groupBy(*keys) if keys else rows.groupBy()
    d = g.agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    d = d.where("n > 0")
    # Centred sums of products; a matrix column keeps them from being worked out again and again.
    centred = {(i, j): F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") for i in range(k + 1) for j in range(i, k + 1)}
    d = d.select(*keys, "n", F.array(*[F.col(f"s{i}") / F.col("n") for i in range(k + 1)]).alias("means"),
                 F.array(*[F.when(centred[i, i] > 1e-12 * F.col(f"p{i}_{i}"), F.sqrt(centred[i, i])).otherwise(F.lit(0.0)) for i in range(k + 1)]).alias("scale"),
                 F.array(*[centred[min(i, j), max(i, j)] for i in range(k) for j in range(k + 1)]).alias("moments"))
    m = k + 1
    share = lambda v, p: F.get("scale", ((p - p % m) / m).cast("int")) * F.get("scale", p % m)
    d = d.withColumn("matrix", F.transform("moments", lambda v, p: F.when(share(v, p) > 0, v / share(v, p)).otherwise(F.lit(0.0))))
    d = d.select(*keys, "n", "means", "scale", solve(F.col("matrix"), k).alias("betas"))
    raw = F.transform("betas", lambda b, i: F.when(F.get("scale", i) > 0, b * F.get("scale", F.lit(k)) / F.get("scale", i)).otherwise(F.lit(0.0)))
    d = d.select(*keys, "n", "means", "betas", raw.alias("coefficients"))
    return d.select(*keys, "n", "betas", "coefficients", (F.get("means", F.lit(k)) - dot(F.col("coefficients"), F.col("means"))).alias("intercept"))


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of ``a``'s values with the first ones of ``b``."""
    return F.aggregate(F.transform(a, lambda v, i: v * F.get(b, i)), F.lit(0.0), lambda s, v: s + v)


def predicted(coefficients: Column, intercept: Column, features: dict[str, Column], names: Sequence[str] = FEATURES) -> Column:
    """A linear model's value for the given feature expressions."""
    return intercept + dot(coefficients, F.array(*[features[c].cast("double") for c in names]))


def score(rows: DataFrame, models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the ``prediction`` of their key's model; rows without a model are left out."""
    m = models.select(*keys, "coefficients", "intercept")
    d = rows.join(m, list(keys)) if keys else rows.crossJoin(F.broadcast(m))  # one row without keys
    value = predicted(F.col("coefficients"), F.col("intercept"), {c: F.col(c) for c in FEATURES})
    return d.withColumn("prediction", value).drop("coefficients", "intercept")


def linear_metrics(rows: DataFrame, models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test-split metrics of every key's model."""
    return regression_metrics(score(rows.where("split = 'test'"), models, keys), keys, n_train=split_counts(rows, keys))


def fit_series(series: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Training rows and one model per series that has enough of them."""
    rows = training_rows(series, keys)
    return rows, fit_linear(rows.where("split = 'train'"), keys)


def folded_forecast(series: DataFrame, models: DataFrame, keys: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """``(keys..., step, ds, predicted)``: the recursive forecast of linear models as one projection.

    The fold's state is the array of values so far; a step builds the next day's features from its end, clips the
    model's value at 0 and appends it.
    """
    keys = list(keys)
    m = models.select(*keys, "coefficients", "intercept")
    state = initial_state(series, keys)
    state = state.join(m, keys) if keys else state.crossJoin(F.broadcast(m))

    def step(h: Column, i: Column) -> Column:
        features = step_features(h, F.date_add("last_ds", i + 1), F.col("n_rows").cast("int") + i)
        value = predicted(F.col("coefficients"), F.col("intercept"), features)
        return F.concat(h, F.array(clip_nonnegative(value)))

    values = F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), F.col("hist").cast("array<double>"), step)
    points = state.select(*keys, "last_ds", F.posexplode(F.slice(values, F.size("hist") + 1, F.lit(horizon))).alias("step", "predicted"))
    return points.select(*keys, "step", F.date_add("last_ds", F.col("step") + 1).alias("ds"), "predicted")


def linear_forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = HORIZON) -> tuple[DataFrame, DataFrame]:
    """``(points, metrics)``: a model for each series, its forecast with bounds of its own error, and its test metrics."""
    keys = list(keys)
    rows, models = fit_series(series, keys)
    metrics = linear_metrics(rows, models, keys)
    points = folded_forecast(series, models, keys, horizon)
    mae = metrics.select(*keys, F.col("mae").alias("_mae"))
    points = points.join(mae, keys) if keys else points.crossJoin(F.broadcast(mae))
    return forecast_interval(points, F.col("_mae")).drop("_mae"), metrics


def from_pipeline(model: PipelineModel) -> tuple[list[float], float]:
    """Coefficients and intercept, on the features' own scale, of a fitted scaler and linear regression."""
    scaler, linear = model.stages[1], model.stages[2]
    scaled = [float(b) / float(s) if s else 0.0 for b, s in zip(linear.coefficients.toArray(), scaler.std.toArray())]
    return scaled, float(linear.intercept) - sum(c * float(m) for c, m in zip(scaled, scaler.mean.toArray()))

