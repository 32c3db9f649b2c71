"""Features, training split, metrics, forecast and stores on a seeded
synthetic daily series (trend + weekly cycle + noise)."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.plans import charts as C
from tillsight.plans import features as FT
from tillsight.plans import forecast as FC
from tillsight.sources import stores


def _series(spark, days, start=date(2024, 1, 1), key=None):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(days):
        y = 500 + 300 * i / max(days - 1, 1) + 100 * math.sin(2 * math.pi * i / 7) + rng.normal(0, 50)
        rows.append(((key,) if key else ()) + (start + timedelta(days=i), round(max(y, 0.0), 2)))
    schema = ("k string, " if key else "") + "ds date, y double"
    return spark.createDataFrame(rows, schema).withColumn("y", F.col("y").cast("decimal(24,4)"))


@pytest.fixture(scope="module")
def daily180(spark):
    return _series(spark, 180).persist()


def test_feature_invariants(spark, daily180):
    f = FT.build_features(daily180).orderBy("ds").collect()
    assert len(f) == 180
    assert [r.trend for r in f[:3]] == [0, 1, 2]
    assert all(0 <= r.day_of_week <= 6 and 1 <= r.quarter <= 4 for r in f)
    assert all(-1 <= r.month_sin <= 1 and -1 <= r.dow_cos <= 1 for r in f)
    assert f[0].lag_1d is None and f[1].lag_1d == f[0].y
    assert f[7].lag_7d == f[0].y
    assert f[1].rolling_mean_7d == pytest.approx(f[0].y)
    assert f[6].rolling_mean_30d is None and f[7].rolling_mean_30d is not None
    assert f[1].rolling_std_7d == 0.0 and f[2].rolling_std_7d > 0
    ys = [r.y for r in f[10:17]]
    assert f[17].rolling_mean_7d == pytest.approx(sum(ys) / 7)
    # 2024-01-06 is a Saturday
    sat = [r for r in f if r.ds == date(2024, 1, 6)][0]
    assert sat.is_weekend == 1 and sat.day_of_week == 5


def test_training_split(spark, daily180):
    rows = FT.training_rows(daily180).collect()
    assert len(rows) == 150                       # first 30 rows lack lag_30d
    train = [r for r in rows if r.split == "train"]
    assert len(train) == 120
    assert max(r.ds for r in train) < min(r.ds for r in rows if r.split == "test")


def test_short_series_rejected(spark):
    st = FT.training_status(_series(spark, 10)).collect()[0]
    assert not st.eligible and st.reason == "fewer than 30 days with sales"
    st = FT.training_status(_series(spark, 45)).collect()[0]
    assert not st.eligible and "complete" in st.reason
    with pytest.raises(ValueError, match="Not enough data"):
        FC.train(_series(spark, 45), num_trees=5)


def test_state_features_equal_window_features(spark, daily180):
    """The array state gives the same features as the window plan."""
    cut = daily180.where(F.col("ds") < date(2024, 3, 1))
    nxt = daily180.where(F.col("ds") == date(2024, 3, 1))
    win = FT.build_features(cut.unionByName(nxt)).where(F.col("ds") == date(2024, 3, 1)).collect()[0]
    st = FC.next_features(FC.initial_state(cut)).collect()[0]
    for name in FT.FEATURES:
        assert getattr(st, name) == pytest.approx(getattr(win, name), abs=1e-6), name


def test_train_forecast_and_cache(spark, daily180, tmp_path):
    res = FC.train_and_forecast(daily180, num_trees=10)
    pts = res.points.orderBy("step").collect()
    assert len(pts) == 30
    assert pts[0].ds == date(2024, 6, 29)                  # day after the last one
    assert all(p.lower_bound >= 0 and p.upper_bound >= p.predicted_revenue >= 0 for p in pts)
    widths = [p.upper_bound - p.predicted_revenue for p in pts]
    assert widths[-1] > widths[0]
    m = res.metrics.collect()[0]
    assert m.model_type in ("linear_regression", "random_forest") and m.mae > 0
    assert m.training_samples == 120 and m.test_samples == 30

    chart = C.chart_forecast(daily180, res.points).collect()
    assert len(chart) == 60 + 3 * 30
    b = C.forecast_boundary(C.chart_forecast(daily180, res.points)).collect()[0]
    assert b.first_forecast_pos == 60

    store = str(tmp_path / "fc")
    stores.save_forecast(res.points.withColumn("file_id", F.lit(3)),
                         res.metrics.withColumn("file_id", F.lit(3)), store)
    got_pts, got_met = stores.load_forecast(spark, store, "file_id", 3)
    assert got_pts.count() == 30
    assert got_met.collect()[0].rmse == m.rmse          # kept on a cache hit
    assert stores.load_forecast(spark, store, "file_id", 4) is None

    path = stores.save_model(res.model.model, str(tmp_path / "models"), "3", res.model.model_type)
    again = stores.load_model(path)
    assert again.transform(FT.training_rows(daily180)).count() == 150


def test_many_series_pooled(spark):
    a, b = _series(spark, 90, key="north"), _series(spark, 90, key="south")
    res = FC.train_and_forecast(a.unionByName(b), keys=["k"], horizon=7, num_trees=5)
    per = {r.k: r["count"] for r in res.points.groupBy("k").count().collect()}
    assert per == {"north": 7, "south": 7}


def test_keyed_bounds_and_refused_series(spark):
    """Each series gets bounds of its own error; one too short gets a reason, not a forecast."""
    big = _series(spark, 90, key="big").withColumn("y", (F.col("y") * 1000).cast("decimal(24,4)"))
    rows = big.unionByName(_series(spark, 90, key="small")).unionByName(_series(spark, 5, key="short"))
    res = FC.train_and_forecast(rows, keys=["k"], horizon=3, num_trees=5)
    width = {r.k: r.upper_bound - r.predicted_revenue for r in res.points.collect()}
    assert set(width) == {"big", "small"}
    assert [(r.k, r.reason) for r in res.refused.collect()] == [("short", "fewer than 30 days with sales")]
    mae = {r.k: r.mae for r in res.model.key_metrics.collect()}
    assert set(mae) == {"big", "small"} and mae["big"] != mae["small"]
    last = {r.k: r.upper_bound - r.predicted_revenue for r in res.points.where("step = 2").collect()}
    assert all(last[k] == pytest.approx(mae[k] * (1.5 + 0.02 * 2), abs=0.02) for k in mae)


def test_series_far_apart_in_size_err_alike(spark):
    """A series and itself a thousand times as large: same relative errors, same relative forecasts, by either model."""
    small = _series(spark, 120, key="small")
    big = _series(spark, 120, key="big").withColumn("y", (F.col("y") * 1000).cast("decimal(24,4)"))
    rows = small.unionByName(big).persist()
    trained = FC.train(rows, ["k"], num_trees=5)
    scale = {r.k: r.scale for r in trained.scales.collect()}
    assert scale["big"] == pytest.approx(1000 * scale["small"])
    mae = {r.k: r.mae for r in trained.key_metrics.collect()}
    assert mae["big"] / scale["big"] == pytest.approx(mae["small"] / scale["small"], rel=0.01)
    linear = FC.linear_pipeline().fit(FC.scaled(FT.training_rows(rows, ["k"]).join(trained.scales, "k")).where("split = 'train'"))
    for points in (FC._stepped(trained.model, rows, ["k"], 5, trained.scales), FC.folded_linear(linear, rows, ["k"], 5, trained.scales)):
        got = {(r.k, r.step): r.predicted for r in points.collect()}
        assert len(got) == 10
        assert all(got["big", i] == pytest.approx(1000 * got["small", i], rel=1e-3) and got["small", i] > 100 for i in range(5))
    stepped = {(r.k, r.step): r.predicted for r in FC._stepped(linear, rows, ["k"], 5, trained.scales).collect()}
    assert all(stepped[x] == pytest.approx(got[x], rel=1e-6) for x in got)


def test_seasonal_naive_repeats_last_week(spark, daily180):
    pts = FC.seasonal_naive(daily180).orderBy("step").collect()
    last7 = [float(r.y) for r in daily180.orderBy(F.desc("ds")).limit(7).collect()][::-1]
    assert [p.predicted for p in pts[:7]] == pytest.approx(last7)
    assert [p.predicted for p in pts[7:14]] == pytest.approx(last7)


def test_forecast_cached_hit_and_retrain(spark, daily180, tmp_path):
    store = str(tmp_path / "cache")
    pts1, met1 = FC.forecast_cached(daily180, store, dataset=7, horizon=5, num_trees=5)
    first = sorted((r.step, r.predicted_revenue) for r in pts1.collect())
    assert len(first) == 5
    pts2, met2 = FC.forecast_cached(daily180, store, dataset=7, horizon=5, num_trees=5)      # hit: no training
    assert sorted((r.step, r.predicted_revenue) for r in pts2.collect()) == first
    assert met2.collect()[0].rmse == met1.collect()[0].rmse
    # Another horizon, other content or a forced run is no hit.
    pts3, _ = FC.forecast_cached(daily180, store, dataset=7, horizon=3, num_trees=5)
    assert pts3.count() == 3
    with pytest.raises(ValueError, match="Not enough data"):
        FC.forecast_cached(daily180.limit(0), store, dataset=7, horizon=5, num_trees=5)


def test_fill_gaps_inserts_zero_days(spark):
    s = spark.createDataFrame([(date(2024, 1, 1), 5.0), (date(2024, 1, 4), 7.0)], "ds date, y double") \
        .withColumn("y", F.col("y").cast("decimal(24,4)"))
    filled = FT.fill_gaps(s).orderBy("ds").collect()
    assert [float(r.y) for r in filled] == [5.0, 0.0, 0.0, 7.0]
    f = FT.build_features(FT.fill_gaps(s)).orderBy("ds").collect()
    assert f[3].lag_1d == 0.0 and f[3].trend == 3


def test_rule_forecast_feeds_its_own_values_back(spark):
    day = date(2024, 1, 1)

    values = {"a": [float(i % 9) for i in range(40)], "b": [5.0] * 12}
    rows = [(k, day + timedelta(i), y) for k, ys in values.items() for i, y in enumerate(ys)]
    series = spark.createDataFrame(rows, "region string, ds date, y double").repartition(7)
    out = FC.forecast_by_rule(series, FC.blend_rule(), ["region"], horizon=20).collect()
    assert len(out) == 40
    for k, ys in values.items():
        h, n = list(ys), len(ys)
        for r in sorted((r for r in out if r.region == k), key=lambda r: r.step):
            h.append(max(0.0, 0.5 * h[-1] + 0.3 * h[-7] + 0.2 * (sum(h[-7:]) / 7)))
            assert abs(r.predicted - h[-1]) < 1e-9 and r.ds == day + timedelta(n + r.step)
