"""Manifest log, partitioned dataset store, schema description, enforcement."""

import os

import pytest

from tillsight.operators import clean as CL
from tillsight.operators import headers as H
from tillsight.operators import quality as Q
from tillsight.sources import csv_files as CSV
from tillsight.sources import stores


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("uploads")
    (d / "one.csv").write_text("date,amount,item\n2024-01-02,4,a\n2024-01-03,6,b\n")
    (d / "two.csv").write_text("date,amount\n2024-02-02,1\n2024-02-03,x\n2024-02-04,y\n")
    return str(d)


def test_manifest_lifecycle(spark, folder, tmp_path):
    raw, mapping, plan = CSV.read_sales_files(spark, folder)
    widths = spark.createDataFrame([(k, len(v)) for k, v in plan["headers"].items()],
                                   "dataset_id string, column_count int")
    path = str(tmp_path / "manifest")
    entries = stores.manifest_entries(plan["files"], raw, widths, stores.next_id(spark, path))
    stores.append_manifest(entries, path)
    m = stores.read_manifest(spark, path)
    rows = {os.path.basename(r.dataset_id): r for r in m.collect()}
    assert rows["one.csv"].row_count == 2 and rows["one.csv"].column_count == 3
    assert rows["two.csv"].row_count == 3
    assert [r.id for r in stores.manifest_latest_first(m).collect()] == sorted(
        [r.id for r in m.collect()], key=lambda i: (rows_by_id(m)[i].uploaded_at, i), reverse=True)
    one = rows["one.csv"].id
    assert stores.manifest_lookup(m, one).count() == 1
    with pytest.raises(ValueError, match="not found"):
        stores.manifest_lookup(m, 999)

    sales_path = str(tmp_path / "sales")
    stores.write_sales(CL.normalize_sales(raw), sales_path, m)
    got = stores.load_dataset(spark, sales_path, m, one)
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "file_id" in plan.split("PartitionFilters: [")[1].split("]")[0]

    gone = stores.manifest_delete(spark, path, [one])
    assert [r.id for r in gone.collect()] == [one]
    m2 = stores.read_manifest(spark, path)
    assert one not in [r.id for r in m2.collect()]
    with pytest.raises(ValueError):
        stores.load_dataset(spark, sales_path, m2, one)
    assert stores.next_id(spark, path) == max(r.id for r in m.collect()) + 1


def rows_by_id(m):
    return {r.id: r for r in m.collect()}


def test_describe_schema_and_enforce(spark, folder):
    raw, mapping, plan = CSV.read_sales_files(spark, folder)
    d = H.describe_schema(raw).collect()
    assert d[0].row_count == 5 and d[0].column_count == len(raw.columns)
    assert [r.name for r in sorted(d, key=lambda r: r.pos)][:2] == ["dataset_id", "order_date"]

    rep = Q.validation_report(raw)
    ok = {os.path.basename(r.dataset_id) for r in Q.enforce(rep).collect()}
    assert ok == {"one.csv"}
    msg = {os.path.basename(r.dataset_id): r.message for r in Q.failures(rep).collect()}
    assert msg["two.csv"] == "Column 'net_revenue' has too many non-numeric values (2/3 rows)."

    no_rev = spark.createDataFrame([("2024-01-01",)], "order_date string")
    mapped = H.header_positions(spark, no_rev.columns)
    assert H.missing_required(mapped) == ["net_revenue"]
    assert H.canonicalize(spark.createDataFrame([(1, 2)], "`Sale Date` int, Qty int")).columns == [
        "order_date", "quantity"]


def test_observed_dropped_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("bad",), (None,)], "d string")
    parsed = CL.parse_order_date(df, "d", fmt="yyyy-MM-dd", out="order_date")
    kept, obs = CL.drop_bad_dates(parsed)
    assert kept.count() == 1
    assert obs.get["dropped"] == 2


def test_raise_if_invalid(spark):
    bad = spark.createDataFrame([("2024-01-01", "x")], "order_date string, net_revenue string")
    rep = Q.validation_report(bad, keys=[])
    with pytest.raises(ValueError, match="at least 2 data rows"):
        Q.raise_if_invalid(rep, "upload.csv", keys=[])
    good = spark.createDataFrame([("2024-01-01", "1"), ("2024-01-02", "2")], "order_date string, net_revenue string")
    Q.raise_if_invalid(Q.validation_report(good, keys=[]), "ok.csv", keys=[])


def test_latest_per_key_keeps_columns_and_null_keys(spark):
    rows = [(1, "a", 5), (2, "a", 7), (3, None, 1), (4, None, None), (5, "b", None)]
    df = spark.createDataFrame(rows, "id int, k string, at int")
    out = stores.latest_per_key(df, ["k"], ["at", "id"])
    assert out.columns == df.columns
    assert sorted(r.id for r in out.collect()) == [2, 3, 5]
    assert stores.latest_per_key(df.limit(0), ["k"], ["at"]).count() == 0
