"""Hand-computed figures on an invented eight-row table."""

import pytest

from tillsight.operators import aggregates as A
from tillsight.plans import charts as C
from tillsight.plans import reports as REP

# Revenue: Lamp 301.25, Rug 409.00, Kettle 135.00, Mug 60.00 -> total 905.25
# Months: 2023-04 375.50, 2023-05 306.75, 2023-06 223.00


def test_kpis(spark, sales8):
    k = A.kpis(sales8).collect()[0]
    assert k.total_revenue == pytest.approx(905.25)
    assert k.total_orders == 8
    assert k.avg_order_value == pytest.approx(113.16)   # 905.25 / 8 = 113.15625
    assert k.unique_customers == 5
    assert k.top_product == "Rug"
    assert k.top_region == "Plains"                       # 409.00
    assert k.revenue_growth == pytest.approx(-27.3)       # (223 - 306.75) / 306.75


def test_monthly_sorted(spark, sales8):
    m = A.monthly_sales(sales8).collect()
    assert [r.month for r in m] == ["2023-04", "2023-05", "2023-06"]
    assert [r.revenue for r in m] == pytest.approx([375.5, 306.75, 223.0])
    assert [r.orders for r in m] == [3, 3, 2]


def test_top_products_rank_and_limit(spark, sales8):
    t = A.top_products(sales8, limit=3).collect()
    assert [r.product for r in t] == ["Rug", "Lamp", "Kettle"]
    assert [r.rank for r in t] == [1, 2, 3]
    assert [r.units_sold for r in t] == [2, 5, 3]
    with pytest.raises(ValueError):
        A.top_products(sales8, limit=0)


def test_region_shares_sum_to_100(spark, sales8):
    r = A.region_sales(sales8).collect()
    assert r[0].region == "Plains"
    assert sum(x.percentage for x in r) == pytest.approx(100.0, abs=0.5)
    assert {x.region: x.orders for x in r} == {"Plains": 2, "Coast": 2, "Hills": 2, "Valley": 2}


def test_category_and_weekly(spark, sales8):
    c = A.category_sales(sales8).collect()
    assert [(x.category, x.units_sold) for x in c] == [("Home", 7), ("Kitchen", 13)]
    w = A.weekly_sales(sales8).collect()
    assert str(w[0].week_start) == "2023-04-03"          # a Monday
    assert sum(x.orders for x in w) == 8


def test_ties_break_on_smallest_key(spark):
    from datetime import datetime
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1), "B", "East", 10.0), (datetime(2024, 1, 2), "A", "West", 10.0)],
        "order_date timestamp, product string, region string, net_revenue double")
    k = A.kpis(df).collect()[0]
    assert (k.top_product, k.top_region) == ("A", "East")
    assert k.revenue_growth is None                       # one month only
    assert k.unique_customers == 1                        # all 'Unknown'


def test_growth_none_when_previous_month_zero(spark):
    from datetime import datetime
    df = spark.createDataFrame(
        [(datetime(2024, 1, 5), 0.0), (datetime(2024, 3, 5), 50.0)],
        "order_date timestamp, net_revenue double")
    assert A.mom_growth(df).collect()[0].revenue_growth is None


def test_intraday_rows_share_one_week(spark):
    from datetime import datetime
    df = spark.createDataFrame(
        [(datetime(2024, 5, 8, 9, 30), 5.0), (datetime(2024, 5, 8, 17, 45), 7.0)],
        "order_date timestamp, net_revenue double")
    w = A.weekly_sales(df).collect()
    assert len(w) == 1 and w[0].orders == 2
    d = A.daily_revenue(df).collect()
    assert len(d) == 1 and d[0].revenue == 12.0


def test_charts_and_units(spark, sales8):
    trend = C.chart_trend(sales8).collect()
    assert len(trend) == 6 and {r.series for r in trend} == {"revenue", "orders"}
    u = C.units_leaders(sales8, limit=3).collect()
    # top 3 by revenue (Rug, Lamp, Kettle) re-sorted by units
    assert [r.product for r in u] == ["Lamp", "Kettle", "Rug"]
    payload = C.to_payload(C.chart_bundle(sales8)).collect()
    trend_row = [r for r in payload if r.chart == "trend"][0]
    assert trend_row.labels == ["2023-04", "2023-05", "2023-06"]
    assert len(trend_row.datasets) == 2


def test_summary_and_payload(spark, sales8):
    s = REP.summary_text(sales8).collect()[0].summary
    assert s.startswith("Dataset covers 2023-04 to 2023-06 with 8 orders generating $905.25")
    assert s.endswith("Revenue declined 27.3% month-over-month.")
    p = REP.analytics_payload(sales8).collect()[0]
    assert p.kpis.total_orders == 8
    assert [m.month for m in p.monthly_sales] == ["2023-04", "2023-05", "2023-06"]
    assert [x.product for x in p.top_products][:2] == ["Rug", "Lamp"]


def test_same_result_any_partitioning(spark, sales8):
    base = sorted(A.monthly_sales(sales8).collect())
    for n in (1, 4, 17):
        assert sorted(A.monthly_sales(sales8.repartition(n)).collect()) == base


def test_keys_give_per_group_results(spark, sales8):
    per = {r.category: r for r in A.kpis(sales8, keys=["category"]).collect()}
    assert per["Home"].total_orders == 4
    assert per["Kitchen"].top_product == "Kettle"


def test_units_leaders_by_units(spark, sales8):
    u = C.units_leaders(sales8, limit=2, by="units").collect()
    # Mug sold 10 units, Lamp 5
    assert [(r.product, r.units_sold) for r in u] == [("Mug", 10), ("Lamp", 5)]
    with pytest.raises(ValueError):
        C.units_leaders(sales8, by="margin")


def test_reports_read_the_facts_twice(spark):
    from tillsight.sources.star import StarSales

    src = StarSales(spark, "/root/testdata/sf0.001")
    for build in (A.kpis, REP.analytics_payload, REP.summary_text):
        df = build(src)
        df.collect()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation [l_orderkey" in line for line in plan.splitlines()) == 2, plan


def test_overview_of_keys_ties_and_nothing(spark, sales8):
    empty = sales8.limit(0)
    p = REP.analytics_payload(empty).collect()
    assert len(p) == 1 and p[0].kpis.total_orders == 0 and p[0].kpis.top_product is None and p[0].monthly_sales == []
    assert REP.analytics_payload(empty, keys=["region"]).count() == 0
    # A key that is also a dimension, and a NULL key.
    from pyspark.sql import functions as F
    df = sales8.withColumn("region", F.when(F.col("region") != "Hills", F.col("region")))
    per = {r.region: r for r in REP.analytics_payload(df, keys=["region"]).collect()}
    assert set(per) == {None, "Coast", "Plains", "Valley"}
    assert per[None].kpis.total_orders == 2 and per[None].kpis.total_revenue == 81.0
    assert [x.product for x in per["Valley"].top_products] == ["Kettle", "Mug"]
    # More products than one bucket, all tied: the first by name.
    rows = [(f"p{i:04d}",) for i in range(1000)]
    many = spark.createDataFrame(rows, "product string").selectExpr(
        "product", "timestamp'2024-01-01' as order_date", "cast(5 as decimal(24,4)) as net_revenue", "'c' as category", "'r' as region", "'x' as customer_id")
    top = REP.analytics_payload(many, top_n=7).collect()[0]
    assert [x.product for x in top.top_products] == [f"p{i:04d}" for i in range(7)]
    assert top.kpis.unique_customers == 1 and top.region_sales[0].percentage == 100.0 and top.category_sales[0].units_sold == 1000
