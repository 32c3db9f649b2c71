"""Daily-series features for forecasting (many series at once).

A series is ``(keys..., ds DATE, y)`` with one row per day that had sales.
All 19 features are window expressions over one window spec partitioned by
the series keys and ordered by ``ds``, so Spark sorts each series once
inside its partition; the unkeyed case is a single series of at most one
row per calendar day.

Lags and the trend count *rows*, not calendar days (days without sales are
absent), as in the reference; :func:`fill_gaps` inserts the missing days
with revenue 0 when calendar lags are wanted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import no_negative_zero
from ..operators.aggregates import daily_revenue_exact

# The feature columns in model order.
FEATURES = (
    "day_of_week", "day_of_month", "month", "quarter",
    "day_of_year", "is_weekend", "week_of_year", "trend",
    "lag_1d", "lag_7d", "lag_14d", "lag_30d",
    "rolling_mean_7d", "rolling_mean_30d", "rolling_std_7d",
    "month_sin", "month_cos", "dow_sin", "dow_cos",
)
LAGS = (1, 7, 14, 30)
MIN_DAYS = 30          # daily rows needed before features
MIN_TRAIN_ROWS = 30    # complete feature rows needed to train
TRAIN_SHARE = 0.8


def daily_series(src, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., ds, y)``: exact daily revenue (DECIMAL) of days with sales."""
    return daily_revenue_exact(src, keys).select(*keys, "ds", F.col("revenue").alias("y"))


def fill_gaps(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Insert days without sales (y = 0) between each series' first and last day."""
    keys = list(keys)
    g = series.groupBy(*keys) if keys else series.groupBy()
    span = g.agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("ds"))
    out = days.join(series, keys + ["ds"], "left")
    return out.withColumn("y", F.coalesce("y", F.lit(0).cast(series.schema["y"].dataType)))


def calendar(ds: Column) -> dict[str, Column]:
    dow = F.weekday(ds)                     # Monday = 0
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(ds),
        "month": F.month(ds),
        "quarter": F.quarter(ds),
        "day_of_year": F.dayofyear(ds),
        "is_weekend": (dow >= 5).cast("int"),
        "week_of_year": F.weekofyear(ds),
    }


def cyclic(month: Column, dow: Column) -> dict[str, Column]:
    two_pi = 2 * math.pi
    r = lambda c: no_negative_zero(F.round(c, 6))
    return {
        "month_sin": r(F.sin(F.lit(two_pi) * month / 12)),
        "month_cos": r(F.cos(F.lit(two_pi) * month / 12)),
        "dow_sin": r(F.sin(F.lit(two_pi) * dow / 7)),
        "dow_cos": r(F.cos(F.lit(two_pi) * dow / 7)),
    }


def build_features(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., ds, y DOUBLE, <19 features>)``.

    Rolling means are exact decimal window sums divided by the count, so
    they do not depend on summation order; the rolling standard deviation
    is rounded to 4 decimals.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ds")
    w7 = w.rowsBetween(-7, -1)
    w30 = w.rowsBetween(-30, -1)
    y = F.col("y")
    yd = y.cast("double")
    n7, n30 = F.count(y).over(w7), F.count(y).over(w30)
    cols = calendar(F.col("ds"))
    cols["trend"] = (F.row_number().over(w) - 1).cast("int")
    for k in LAGS:
        cols[f"lag_{k}d"] = F.lag(yd, k).over(w)
    cols["rolling_mean_7d"] = F.when(n7 >= 1, F.sum(y).over(w7).cast("double") / n7)
    cols["rolling_mean_30d"] = F.when(n30 >= 7, F.sum(y).over(w30).cast("double") / n30)
    cols["rolling_std_7d"] = no_negative_zero(F.round(F.coalesce(F.stddev_samp(yd).over(w7), F.lit(0.0)), 4))
    out = series.select(*keys, "ds", yd.alias("y"), *[c.alias(n) for n, c in cols.items()])
    cyc = cyclic(F.col("month"), F.col("day_of_week"))
    return out.withColumns(cyc).select(*keys, "ds", "y", *FEATURES)


# --------------------------------------------------------------------- M4
def training_status(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per series: days, complete feature rows, and whether it can be trained."""
    keys = list(keys)
    feats = build_features(series, keys)
    complete = F.lit(True)
    for c in FEATURES:
        complete = complete & F.col(c).isNotNull()
    g = feats.groupBy(*keys) if keys else feats.groupBy()
    s = g.agg(F.count(F.lit(1)).alias("n_days"), F.count_if(complete).alias("n_complete"))
    reason = (F.when(F.col("n_days") < MIN_DAYS, F.lit("fewer than 30 days with sales"))
              .when(F.col("n_complete") < MIN_TRAIN_ROWS, F.lit("fewer than 30 complete feature rows")))
    return s.select(*keys, "n_days", "n_complete", reason.isNull().alias("eligible"), reason.alias("reason"))


def training_rows(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Complete feature rows of eligible series, with ``split`` train/test.

    The first ``int(0.8 * n)`` rows of each series (by date) train, the rest
    test; nothing is shuffled across time.
    """
    keys = list(keys)
    feats = build_features(series, keys).dropna(subset=list(FEATURES))
    w = Window.partitionBy(*keys).orderBy("ds")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(w)
    # >= 30 complete rows implies >= 30 days with sales (status rule).
    out = feats.withColumn("_n", n).where(F.col("_n") >= MIN_TRAIN_ROWS)
    split = F.when(rn <= F.floor(F.col("_n") * TRAIN_SHARE), F.lit("train")).otherwise(F.lit("test"))
    return out.withColumn("split", split).drop("_n")


def recent_history(series: DataFrame, keys: Sequence[str] = (), days: int = 60) -> DataFrame:
    """The last ``days`` rows of each series (W9)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    return series.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= days).drop("_r")
