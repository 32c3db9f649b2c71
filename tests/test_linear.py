from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.plans import features as FT
from tillsight.plans import forecast as FC
from tillsight.plans import linear as LIN


def _series(spark, scales=(1.0, 1000.0), n=150):
    rng = np.random.default_rng(3)
    y = [200 + 40 * np.sin(i / 7) + 0.6 * i + 15 * (i % 7 == 3) + rng.normal() for i in range(n)]
    rows = [(f"s{k}", date(2023, 1, 2) + timedelta(days=i), round(float(v * s), 3)) for k, s in enumerate(scales) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, ds date, y double").withColumn("y", F.col("y").cast("decimal(24,4)"))


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4)) * [1, 10, 1000, 0.01] + [5, -3, 1e4, 0]
    y = x @ [2.0, -1.0, 0.003, 50.0] + 7 + rng.normal(size=80)
    rows = [(("a", "b")[i % 2], *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k string, f0 double, f1 double, f2 double, f3 double, y double")
    names = ["f0", "f1", "f2", "f3"]
    for r in LIN.fit_linear(df, ["k"], names).collect():
        use = np.arange(80) % 2 == (r.k == "b")
        want = np.linalg.lstsq(np.column_stack([x[use], np.ones(40)]), y[use], rcond=None)[0]
        assert r.n == 40 and r.coefficients == pytest.approx(want[:4], rel=1e-7) and r.intercept == pytest.approx(want[4], rel=1e-6)
    whole = LIN.fit_linear(df, (), names).first()
    want = np.linalg.lstsq(np.column_stack([x, np.ones(80)]), y, rcond=None)[0]
    assert whole.coefficients == pytest.approx(want[:4], rel=1e-7)


def test_constant_and_dependent_features(spark):
    rows = [(float(i), 3.0, 2.0 * i + 1, float((i * 7) % 5), 4.0 * i + (i * 7) % 5 + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double")
    m = LIN.fit_linear(df, (), ["a", "b", "c", "d"]).first()
    assert m.coefficients == pytest.approx([4, 0, 0, 1], abs=1e-8) and m.intercept == pytest.approx(1)
    flat = LIN.fit_linear(df.withColumn("y", F.lit(5.0)), (), ["a", "d"]).first()
    assert flat.coefficients == [0.0, 0.0] and flat.intercept == 5
    assert LIN.fit_linear(df.limit(0), (), ["a"]).count() == 0


def test_series_far_apart_are_fitted_alike(spark):
    """Two series a thousand times apart: each model knows its own scale, so relative errors are equal."""
    points, metrics = LIN.linear_forecast(_series(spark), ["k"], 10)
    m = {r.k: r for r in metrics.collect()}
    assert m["s1"].mae / m["s0"].mae == pytest.approx(1000, rel=0.01)
    assert m["s1"].r2_score == pytest.approx(m["s0"].r2_score, abs=1e-3)
    p = {(r.k, r.step): r for r in points.collect()}
    assert len(p) == 20
    for i in range(10):
        assert p["s1", i].predicted_revenue / p["s0", i].predicted_revenue == pytest.approx(1000, rel=1e-3)
        assert p["s0", i].lower_bound <= p["s0", i].predicted_revenue <= p["s0", i].upper_bound


def test_short_series_have_no_model(spark):
    s = _series(spark).where("k = 's0' OR ds < '2023-02-01'")
    points, metrics = LIN.linear_forecast(s, ["k"], 3)
    assert {r.k for r in points.collect()} == {r.k for r in metrics.collect()} == {"s0"}


def test_fold_equals_the_steps(spark):
    """One projection gives what thirty transform plans of the same fitted pipeline give."""
    series = _series(spark, (1.0, 3.0)).cache()
    model = FC.linear_pipeline().fit(FT.training_rows(series, ["k"]).where("split = 'train'"))
    key = lambda r: (r.k, r.step)
    steps = sorted(FC._stepped(model, series, ["k"], 30).collect(), key=key)
    fold = FC.folded_linear(model, series, ["k"], 30)
    assert "Python" not in fold._jdf.queryExecution().executedPlan().toString()
    fold = sorted(fold.collect(), key=key)
    assert [(r.k, r.step, r.ds) for r in fold] == [(r.k, r.step, r.ds) for r in steps]
    assert [r.predicted for r in fold] == pytest.approx([r.predicted for r in steps], rel=1e-6)
    series.unpersist()


def test_only_changed_series_are_trained_again(spark, tmp_path):
    from tillsight.plans import forecast_store as ST

    path = str(tmp_path / "store")
    series = _series(spark, (1.0, 10.0, 5.0))
    points, metrics = ST.forecast_many(series, ["k"], path, 5)
    first = sorted(points.collect())
    assert len(first) == 15 and metrics.count() == 3 and spark.read.parquet(path).count() == 3
    want = sorted(LIN.linear_forecast(series, ["k"], 5)[0].collect())
    assert [tuple(r) for r in first] == [tuple(r) for r in want]
    again = ST.forecast_many(series.repartition(5), ["k"], path, 5)[0]
    assert sorted(again.collect()) == first and spark.read.parquet(path).count() == 3
    changed = series.withColumn("y", F.expr("CASE WHEN k = 's1' AND ds = '2023-02-03' THEN y + 50 ELSE y END"))
    out = sorted(ST.forecast_many(changed, ["k"], path, 5)[0].collect())
    assert spark.read.parquet(path).groupBy("k").count().where("count > 1").collect()[0].k == "s1"
    assert [r for r in out if r.k != "s1"] == [r for r in first if r.k != "s1"] and out != first
    ST.forecast_many(series, ["k"], path, 6)  # another horizon is another forecast
    assert spark.read.parquet(path).count() == 7


def test_no_series_can_be_trained(spark, tmp_path):
    from tillsight.plans import forecast_store as ST

    short = _series(spark, (1.0,), 20)
    points, metrics = ST.forecast_many(short, ["k"], str(tmp_path / "s"), 5)
    assert points.count() == 0 and metrics.count() == 0
