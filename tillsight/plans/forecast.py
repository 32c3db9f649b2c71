"""Model training, selection and the recursive revenue forecast.

* Training rows come from :mod:`tillsight.plans.features`; two Spark ML
  pipelines are fitted on the train split (standardised ordinary least
  squares, and a 100-tree random forest), scored on the test split with
  SQL aggregates, and the forest is kept when its rounded R^2 is at least
  the linear model's.  With series keys one pooled model is fitted over
  all series (a global forecasting model): each series' values are divided
  by its own scale, the mean size of its train split, so that the largest
  series decides neither the loss nor the choice of the model; predictions
  are multiplied by it again.  With no keys this is exactly the
  single-series case.
* The forecast is recursive: each of the ``horizon`` steps builds the 19
  features of the next day from a per-series state (last date, row count
  and an array of the last 30 values), predicts, clips at 0 and appends
  the prediction to the state.  A step is a projection plus
  ``model.transform`` over one row per series - no shuffle - and the
  state is checkpointed to the reliable checkpoint folder every few steps
  to keep the plan short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clip_nonnegative
from ..session import cut_lineage
from .features import FEATURES, calendar, cyclic, training_rows, training_status

HORIZON = 30
STATE_LEN = 30
CHECKPOINT_EVERY = 10
#: Training rows of a partition.
TRAIN_ROWS = 20_000
#: Features in the series' own unit.
VALUE_FEATURES = tuple(c for c in FEATURES if c.startswith(("lag_", "rolling_")))


# --------------------------------------------------------------- M6a M6b
def linear_pipeline() -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LinearRegression(featuresCol="features", labelCol="y", predictionCol="prediction",
                         regParam=0.0, elasticNetParam=0.0, solver="normal"),
    ])


def forest_pipeline(num_trees: int = 100, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
        RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="prediction",
                              numTrees=num_trees, maxDepth=8, minInstancesPerNode=5,
                              featureSubsetStrategy="all", seed=seed,
                              maxMemoryInMB=1024),
    ])


# --------------------------------------------------------------------- M7a
def regression_metrics(scored: DataFrame, keys: Sequence[str] = (), label: str = "y",
                       prediction: str = "prediction", n_train: DataFrame | None = None) -> DataFrame:
    """MAE, RMSE (2 decimals) and R^2 (4 decimals) of clipped predictions.

    R^2 uses the test mean per key (two aggregates joined on the keys).
    """
    keys = list(keys)
    s = scored.withColumn("_p", clip_nonnegative(F.col(prediction))).withColumn("_e", F.col(label) - F.col("_p"))
    g = s.groupBy(*keys) if keys else s.groupBy()
    mean = g.agg(F.avg(label).alias("_ybar"))
    j = s.join(mean, keys) if keys else s.crossJoin(F.broadcast(mean))
    g2 = j.groupBy(*keys) if keys else j.groupBy()
    m = g2.agg(
        F.avg(F.abs("_e")).alias("_mae"),
        F.avg(F.col("_e") * F.col("_e")).alias("_mse"),
        F.sum(F.col("_e") * F.col("_e")).alias("_ssr"),
        F.sum((F.col(label) - F.col("_ybar")) ** 2).alias("_sst"),
        F.count(F.lit(1)).alias("test_samples"))
    r2 = F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_ssr") / F.col("_sst")).otherwise(
        F.when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))   # constant test values: perfect or not
    out = m.select(*keys, F.round("_mae", 2).alias("mae"), F.round(F.sqrt("_mse"), 2).alias("rmse"),
                   F.round(r2, 4).alias("r2_score"), "test_samples")
    if n_train is not None:
        out = out.join(n_train, keys) if keys else out.crossJoin(n_train)
    return out


def split_counts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    g = rows.groupBy(*keys) if keys else rows.groupBy()
    return g.agg(F.count_if(F.col("split") == "train").alias("training_samples"))


@dataclass
class TrainedModel:
    model_type: str
    model: PipelineModel
    metrics: DataFrame          # one row (pooled) with mae, rmse, r2_score, counts
    candidates: dict            # model_type -> metrics row (as dict)
    key_metrics: DataFrame | None = None    # the same figures per series, when keyed
    scales: DataFrame | None = None         # (keys..., scale) of every trained series, when keyed


# ------------------------------------------------------------ series' own scale
def series_scales(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., scale)``: the mean size of each series' train values, 1 for a series of zeros."""
    size = F.avg(F.when(F.col("split") == "train", F.abs(F.col("y"))))
    return rows.groupBy(*keys).agg(size.alias("scale")).withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0)))


def scaled(rows: DataFrame, columns: Sequence[str] = (*VALUE_FEATURES, "y")) -> DataFrame:
    """``rows`` (with a ``scale``) in units of their series' scale."""
    return rows.withColumns({c: F.col(c) / F.col("scale") for c in columns})


def in_money(predictions: DataFrame) -> DataFrame:
    """Predictions and true values of scaled rows, back in the series' own unit."""
    return predictions.withColumns({c: F.col(c) * F.col("scale") for c in ("prediction", "y")})


# --------------------------------------------------------------------- M7b
def train(series: DataFrame, keys: Sequence[str] = (), num_trees: int = 100, seed: int = 42) -> TrainedModel:
    """Fit both pipelines on the train split and keep the better one.

    With keys both are fitted, and compared by R^2, in units of each series'
    scale; the reported figures are in money.
    """
    keys = list(keys)
    rows = training_rows(series, keys).persist()
    # As many hash partitions as the number of rows asks for, each sorted: what a partition holds, and in which order,
    # does not depend on the input's partitioning, which makes the forest's bootstrap reproducible.
    partitions = -(-rows.count() // TRAIN_ROWS) or 1
    used = scaled(rows.join(series_scales(rows, keys), keys)) if keys else rows
    fixed = cut_lineage(used.repartition(partitions, *keys, "ds").sortWithinPartitions(*keys, "ds"))
    rows.unpersist()
    rows = fixed
    n_train = split_counts(rows)
    if n_train.collect()[0].training_samples == 0:
        raise ValueError("Not enough data to train: need at least 30 complete daily feature rows "
                         "(about 60 days with sales).")
    train_df = rows.where("split = 'train'")
    test_df = rows.where("split = 'test'")
    candidates = {"linear_regression": linear_pipeline(),
                  "random_forest": forest_pipeline(num_trees, seed)}

    def fit(name):
        model = candidates[name].fit(train_df)
        told = model.transform(test_df)
        met = regression_metrics(in_money(told) if keys else told, n_train=n_train).collect()[0].asDict()
        return name, model, met, regression_metrics(told).first().r2_score if keys else met["r2_score"]

    # The two candidates are independent Spark jobs: submit them together.
    with ThreadPoolExecutor(max_workers=len(candidates)) as pool:
        results = list(pool.map(fit, candidates))
    fitted = {name: model for name, model, *_ in results}
    scores = {name: met for name, _, met, _ in results}
    r2 = {name: x for name, *_, x in results}
    best = "random_forest" if r2["random_forest"] >= r2["linear_regression"] else "linear_regression"
    spark = rows.sparkSession
    metrics = spark.createDataFrame([{"model_type": best, **scores[best]}])
    return TrainedModel(best, fitted[best], metrics.select(
        "model_type", "mae", "rmse", "r2_score", "training_samples", "test_samples"), scores,
        regression_metrics(in_money(fitted[best].transform(test_df)), keys, n_train=split_counts(rows, keys)) if keys else None,
        rows.select(*keys, "scale").distinct() if keys else None)


# ---------------------------------------------------------------------- M8
def initial_state(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series: last date, number of rows, last 30 values (oldest first)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    recent = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= STATE_LEN)
    g = series.groupBy(*keys) if keys else series.groupBy()
    counts = g.agg(F.count(F.lit(1)).alias("n_rows"), F.max("ds").alias("last_ds"))
    g2 = recent.groupBy(*keys) if keys else recent.groupBy()
    hist = g2.agg(F.array_sort(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y")))).alias("_h"))
    hist = hist.select(*keys, F.transform("_h", lambda s: s["y"]).alias("hist"))
    st = counts.join(hist, keys) if keys else counts.crossJoin(hist)
    return st.select(*keys, "n_rows", F.col("n_rows").alias("n0"), "last_ds", "hist",
                     F.array().cast("array<struct<step:int,ds:date,y:double>>").alias("preds"))


def _tail(hist: Column, k: int) -> Column:
    """The last ``k`` values of ``hist`` (fewer if it is shorter)."""
    return F.slice(hist, F.greatest(F.size(hist) - F.lit(k) + 1, F.lit(1)), F.lit(k))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def step_features(h: Column, ds: Column, trend: Column) -> dict[str, Column]:
    """The 19 features of day ``ds`` from the values ``h`` before it (oldest first).

    Missing history (very short series) gives 0.
    """
    cols = calendar(ds)
    cols["trend"] = trend
    n = F.size(h)
    for k in (1, 7, 14, 30):
        cols[f"lag_{k}d"] = F.when(n >= k, F.element_at(h, -k)).otherwise(F.lit(0.0))
    t7, t30 = _tail(h, 7), _tail(h, 30)
    c7, c30 = F.size(t7), F.size(t30)
    mean7 = _sum(t7) / c7
    cols["rolling_mean_7d"] = F.when(c7 >= 1, mean7).otherwise(F.lit(0.0))
    cols["rolling_mean_30d"] = F.when(c30 >= 7, _sum(t30) / c30).otherwise(F.lit(0.0))
    ss7 = F.aggregate(t7, F.lit(0.0), lambda a, x: a + (x - mean7) * (x - mean7))
    cols["rolling_std_7d"] = F.when(c7 >= 2, F.round(F.sqrt(ss7 / (c7 - 1)), 4)).otherwise(F.lit(0.0))
    cols.update(cyclic(F.month(ds), F.weekday(ds)))
    return cols


def next_feature_columns() -> list[Column]:
    """Expressions for the next day's 19 features from the array state, built once and reused for every step."""
    ds = F.date_add("last_ds", 1)
    cols = step_features(F.col("hist"), ds, F.col("n_rows").cast("int"))
    return [ds.alias("ds")] + [cols[f].alias(f) for f in FEATURES]


def next_features(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return state.select(*state.columns, *next_feature_columns())


def _update_columns(keys: Sequence[str], has_scale: bool = False) -> list[Column]:
    """State after one step: the clipped prediction appended."""
    pred = clip_nonnegative(F.col("prediction") * F.col("scale") if has_scale else F.col("prediction"))
    keep = F.least(F.size("hist") + 1, F.lit(STATE_LEN))
    step = (F.col("n_rows") - F.col("n0")).cast("int")
    return [*[F.col(k) for k in keys],
            (F.col("n_rows") + 1).alias("n_rows"), "n0", F.col("ds").alias("last_ds"),
            F.slice(F.concat("hist", F.array(pred)), -keep, keep).alias("hist"),
            F.concat("preds", F.array(F.struct(step.alias("step"), F.col("ds").alias("ds"),
                                               pred.alias("y")))).alias("preds"),
            *[F.col(c) for c in ("scale",) if has_scale]]


def recursive_forecast(model: PipelineModel, series: DataFrame, keys: Sequence[str] = (),
                       horizon: int = HORIZON, mae: float | Column | DataFrame = 0.0, scales: DataFrame | None = None) -> DataFrame:
    """``(keys..., step, ds, predicted_revenue, lower_bound, upper_bound)``.

    ``scales`` holds the ``scale`` of every series that the model was trained on.

    ``mae`` may be a frame of one row per series with a ``mae`` column, for
    bounds of each series' own error.  Every step has the same plan shape over one row per series, so the
    expressions are built once and generated code is reused.  The state is
    written to the reliable checkpoint folder every ``CHECKPOINT_EVERY``
    steps, which keeps the plan that each step analyses short.  A linear model
    needs no steps: its whole forecast is one projection.
    """
    keys = list(keys)
    if isinstance(model.stages[-1], LinearRegressionModel):
        points = folded_linear(model, series, keys, horizon, scales)
    else:
        points = _stepped(model, series, keys, horizon, scales)
    if isinstance(mae, DataFrame):
        points = points.join(mae.select(*keys, F.col("mae").alias("_mae")), keys)
        return forecast_interval(points, F.col("_mae")).drop("_mae")
    return forecast_interval(points, mae)


def folded_linear(model: PipelineModel, series: DataFrame, keys: Sequence[str], horizon: int, scales: DataFrame | None = None) -> DataFrame:
    """``(keys..., step, ds, predicted)`` of a fitted linear pipeline, without steps.

    In money, a scaled model's coefficients of calendar features and its
    intercept are multiplied by the series' scale; those of values stay.
    """
    from . import linear

    coefficients, intercept = linear.from_pipeline(model)
    one = series.sparkSession.range(1).select(F.array(*map(F.lit, coefficients)).alias("coefficients"), F.lit(intercept).alias("intercept"))
    if scales is not None:
        size = F.col("scale")
        of_value = F.array(*[F.lit(c in VALUE_FEATURES) for c in FEATURES])
        per_series = F.transform("coefficients", lambda c, i: F.when(F.get(of_value, i), c).otherwise(c * size))
        models = scales.crossJoin(F.broadcast(one)).select(*keys, per_series.alias("coefficients"), (F.col("intercept") * size).alias("intercept"))
    else:
        models = series.select(*keys).distinct().crossJoin(one) if keys else one
    return linear.folded_forecast(series, models, keys, horizon)


def _stepped(model: PipelineModel, series: DataFrame, keys: Sequence[str], horizon: int, scales: DataFrame | None = None) -> DataFrame:
    """``(keys..., step, ds, predicted)``, one step after the other; the state is in money."""
    state = initial_state(series, keys)
    state = cut_lineage(state.join(scales, list(keys)) if scales is not None else state)
    feature_cols = next_feature_columns()
    update_cols = _update_columns(keys, scales is not None)
    base = list(state.columns)
    for step in range(horizon):
        now = state.select(*base, *feature_cols)
        scored = model.transform(scaled(now, VALUE_FEATURES) if scales is not None else now)
        state = scored.select(*update_cols)
        if (step + 1) % CHECKPOINT_EVERY == 0 or step + 1 == horizon:
            state = cut_lineage(state)
    points = state.select(*keys, F.inline("preds"))
    return points.withColumnRenamed("y", "predicted")


def forecast_by_rule(series: DataFrame, rule: Callable[[Column], Column], keys: Sequence[str] = (),
                     horizon: int = HORIZON) -> DataFrame:
    """Recursive forecast of a ``rule``: ``(keys..., step, ds, predicted)``.

    ``rule`` maps the array of a series' latest values (oldest first) to the
    next value; it is clipped at 0 and appended.  All steps are one
    projection over one row per series: no loop and no checkpoint.
    """
    keys = list(keys)
    state = initial_state(series, keys)
    start = F.col("hist").cast("array<double>")
    values = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start,
                         lambda h, _: F.concat(h, F.array(clip_nonnegative(rule(h)).cast("double"))))
    points = state.select(*keys, "last_ds", F.posexplode(
        F.slice(values, F.size("hist") + 1, F.lit(horizon))).alias("step", "predicted"))
    return points.select(*keys, "step", F.date_add("last_ds", F.col("step") + 1).alias("ds"), "predicted")


def blend_rule(weights: Sequence[float] = (0.5, 0.3, 0.2)) -> Callable[[Column], Column]:
    """A fixed blend of the last value, the value a week ago and the mean of the last 7 (needs 7 values)."""
    last, week, mean = (F.lit(float(w)) for w in weights)
    return lambda h: (last * F.element_at(h, -1) + week * F.element_at(h, -7)
                      + mean * (_sum(F.slice(h, F.lit(-7), F.lit(7))) / F.lit(7.0)))


# ---------------------------------------------------------------------- M9
def forecast_interval(points: DataFrame, mae: float | Column, pred: str = "predicted") -> DataFrame:
    """Bounds +- mae * (1.5 + 0.02 * step), lower clipped at 0; 2 decimals."""
    mae_c = mae if isinstance(mae, Column) else F.lit(float(mae))
    unc = mae_c * (F.lit(1.5) + F.col("step") * F.lit(0.02))
    p = F.col(pred)
    return points.select(
        *[c for c in points.columns if c not in (pred,)],
        F.round(p, 2).alias("predicted_revenue"),
        F.round(F.greatest(p - unc, F.lit(0.0)), 2).alias("lower_bound"),
        F.round(p + unc, 2).alias("upper_bound"))


# --------------------------------------------------------------------- M12
@dataclass
class ForecastResult:
    points: DataFrame
    metrics: DataFrame
    model: TrainedModel
    refused: DataFrame | None = None    # keyed: series without a forecast, with the reason


def train_and_forecast(series: DataFrame, keys: Sequence[str] = (), horizon: int = HORIZON,
                       num_trees: int = 100, seed: int = 42) -> ForecastResult:
    # The series (one row per day and key) feeds both training and the
    # forecast state; keep it for the duration instead of re-aggregating.
    series = series.persist()
    try:
        trained = train(series, keys, num_trees, seed)
        mae, eligible, refused = trained.candidates[trained.model_type]["mae"], series, None
        if keys:    # only series that can be trained are forecast, each with its own error
            status = training_status(series, keys)
            eligible = series.join(status.where("eligible").select(*keys), keys, "left_semi")
            refused = status.where("NOT eligible").select(*keys, "reason")
            mae = trained.key_metrics
        points = recursive_forecast(trained.model, eligible, keys, horizon, mae, trained.scales)
    finally:
        series.unpersist()
    return ForecastResult(points, trained.metrics, trained, refused)


# ------------------------------------------------- seasonal-naive baseline
def seasonal_naive(series: DataFrame, keys: Sequence[str] = (), horizon: int = HORIZON,
                   season: int = 7) -> DataFrame:
    """Recursive forecast with the predictor ``lag_7d``: the last 7 values
    repeat.  Returns ``(keys..., step, ds, predicted)``."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    last = series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= season)
    g = series.groupBy(*keys) if keys else series.groupBy()
    end = g.agg(F.max("ds").alias("_end"))
    grid = end.select(*keys, "_end", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step"))
    # step h (0-based) copies the value from (season - (h mod season)) rows back.
    grid = grid.withColumn("_r", F.lit(season) - (F.col("step") % season))
    out = grid.join(last, keys + ["_r"]) if keys else grid.join(last, "_r")
    return out.select(*keys, "step", F.date_add("_end", F.col("step") + 1).alias("ds"),
                      F.col("y").cast("double").alias("predicted"))


def naive_metrics(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Test-split metrics of the ``lag_7d`` predictor (M7a with a fixed model)."""
    keys = list(keys)
    rows = training_rows(series, keys)
    n_train = split_counts(rows, keys)
    return regression_metrics(rows.where("split = 'test'"), keys, prediction="lag_7d", n_train=n_train)


# --------------------------------------------------------------------- M10
def forecast_cached(series: DataFrame, store_path: str, dataset: int, force_retrain: bool = False,
                    horizon: int = HORIZON, num_trees: int = 100) -> tuple[DataFrame, DataFrame]:
    """Cached ``(points, metrics)`` for one dataset, trained on a miss.

    A hit needs the same dataset id, content, horizon and model settings:
    all of them are part of the key.

    The cache keeps every metric (rmse and sample counts included), so a
    hit returns the same figures as the run that filled it.
    """
    from ..sources import stores

    spark = series.sparkSession
    content = series.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("ds", "y").cast("decimal(38,0)")).alias("h")).first()
    key = f"{dataset}-{content.n}-{content.h}-{horizon}-{num_trees}"
    if not force_retrain:
        hit = stores.load_forecast(spark, store_path, "cache_key", key)
        if hit is not None:
            return hit
    res = train_and_forecast(series, (), horizon, num_trees)
    pts = res.points.withColumn("cache_key", F.lit(key))
    met = res.metrics.withColumn("cache_key", F.lit(key))
    stores.save_forecast(pts, met, store_path, "cache_key")
    return stores.load_forecast(spark, store_path, "cache_key", key)
