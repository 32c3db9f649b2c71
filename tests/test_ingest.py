"""CSV folders with unlike headers, dirty values and bad files."""

import os

import pytest

from tillsight.operators import clean as CL
from tillsight.operators import headers as H
from tillsight.operators import quality as Q
from tillsight.sources import csv_files as CSV


def _write(folder, name, text, encoding="utf-8"):
    p = os.path.join(folder, name)
    with open(p, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return p


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("landing"))
    _write(d, "shop_a.csv",
           "Order-Date,Sales,Item,Zone,Qty\n"
           "2024-02-01,10.5,Pen,North,2\n"
           "2024-02-03, 20 ,Ink,NA,\n"
           "2024-03-01,N/A,\" Pad \",South,2.7\n")
    _write(d, "shop_b.csv",
           "date,revenue,product_name,region,customer\n"
           "3/2/2024,5,\"Cup, large\",East,k1\n"
           "13/2/2024,7,Cup,East,k2\n"
           "3/15/2024,1e3,\"Say \"\"hi\"\"\",West,k1\n")
    _write(d, "shop_c.csv", "order_date,net_revenue,region\n2024-01-05,12,Süd\n2024-01-06,3,Nord\n",
           encoding="latin-1")
    _write(d, "dup.csv", "order_date,Sales,sales\n2024-04-01,1,100\n2024-04-02,2,200\n")
    _write(d, "header_only.csv", "order_date,net_revenue\n")
    _write(d, "empty.csv", "")
    _write(d, "notes.txt", "hello")
    return d


def test_gate_flags_bad_files(spark, landing):
    files = {r.file_name: r for r in CSV.list_files(spark, landing).collect()}
    assert files["notes.txt"].accepted is False and "extension" in files["notes.txt"].reason
    assert files["empty.csv"].accepted is False and files["empty.csv"].reason == "empty file"
    assert files["shop_a.csv"].accepted


def test_mapping_and_reading(spark, landing):
    raw, mapping, plan = CSV.read_sales_files(spark, landing)
    by = {}
    for r in mapping.collect():
        by.setdefault(os.path.basename(r.dataset_id), {})[r.canonical] = r.header
    assert by["shop_a.csv"] == {"order_date": "Order-Date", "net_revenue": "Sales", "product": "Item",
                                "region": "Zone", "quantity": "Qty"}
    assert by["shop_b.csv"]["customer_id"] == "customer"
    assert by["dup.csv"]["net_revenue"] == "sales"        # the later of two alike headers
    rows = raw.collect()
    a = [r for r in rows if r.dataset_id.endswith("shop_a.csv")]
    assert len(a) == 3
    assert sorted(r.net_revenue for r in a if r.net_revenue) == ["10.5", "20"]
    assert {r.region for r in a} == {"North", None, "South"}
    b = [r for r in rows if r.dataset_id.endswith("shop_b.csv")]
    assert {r.product for r in b} == {"Cup, large", "Cup", 'Say "hi"'}
    c = [r for r in rows if r.dataset_id.endswith("shop_c.csv")]
    assert {r.region for r in c} == {"Süd", "Nord"}        # latin-1 decoded
    d = [r for r in rows if r.dataset_id.endswith("dup.csv")]
    assert sorted(r.net_revenue for r in d) == ["100", "200"]


def test_normalize_and_report(spark, landing):
    raw, mapping, plan = CSV.read_sales_files(spark, landing)
    sales = CL.normalize_sales(raw).collect()
    a = sorted((r for r in sales if r.dataset_id.endswith("shop_a.csv")), key=lambda r: r.order_date)
    assert [float(r.net_revenue) for r in a] == [10.5, 20.0, 0.0]
    assert [r.quantity for r in a] == [2, 1, 2]            # blank -> 1, 2.7 -> 2
    assert [r.region for r in a] == ["North", "Unknown", "South"]
    assert a[2].product == "Pad"
    b = [r for r in sales if r.dataset_id.endswith("shop_b.csv")]
    # month-first wins (2 of 3 parse); 13/2/2024 is dropped
    assert sorted(str(r.order_date.date()) for r in b) == ["2024-03-02", "2024-03-15"]
    assert sorted(float(r.net_revenue) for r in b) == [5.0, 1000.0]

    datasets = spark.createDataFrame(
        [(d, len(h), mapping_row(mapping, d, "order_date"), mapping_row(mapping, d, "net_revenue"),
          sorted(H.header_positions(spark, h))) for d, h in plan["headers"].items()],
        "dataset_id string, column_count int, date_header string, revenue_header string, mapped array<string>")
    rep = {os.path.basename(r.dataset_id): r for r in Q.validation_report(raw, datasets).collect()}
    assert rep["shop_a.csv"].is_valid
    assert rep["header_only.csv"].errors == ["The CSV file contains no data rows."]
    assert not rep["header_only.csv"].is_valid
    assert rep["shop_b.csv"].bad_dates == 1 and rep["shop_b.csv"].is_valid


def mapping_row(mapping, d, canon):
    for r in mapping.collect():
        if r.dataset_id == d and r.canonical == canon:
            return r.header
    return None


def test_missing_required_and_positions(spark):
    m = H.header_positions(spark, [" Sale Date ", "Total Price", "Product Name", "Territory"])
    assert m == {"order_date": 0, "net_revenue": 1, "product": 2, "region": 3}
    assert H.missing_required(H.header_positions(spark, ["product", "category", "revenue"])) == ["order_date"]
    assert H.missing_required(H.header_positions(spark, ["order_date", "product"])) == ["net_revenue"]
    # An exact repeat: the first; unlike spellings of one name: the last.
    assert H.header_positions(spark, ["date", "sales", "sales"])["net_revenue"] == 1
    assert H.header_positions(spark, ["date", "Sales", "sales"])["net_revenue"] == 2


def test_quoted_newlines_and_excel_under_default_arguments(spark, tmp_path):
    d = str(tmp_path)
    _write(d, "a.csv", 'order_date,sales,product\n2024-04-01,1,"a\nb"\n2024-04-02,2,c\n')
    _write(d, "b.xlsx", "no sheet")
    raw, _, plan = CSV.read_sales_files(spark, d)
    assert sorted((r.order_date, r.net_revenue, r["product"]) for r in raw.collect()) == [("2024-04-01", "1", "a\nb"), ("2024-04-02", "2", "c")]
    files = {r.file_name: r for r in plan["files"].collect()}
    assert not files["b.xlsx"].accepted and "xlsx" in files["b.xlsx"].reason


def test_number_guard(spark):
    from tillsight.functions.numbers import parse_double
    vals = ["1e3", " 12 ", "$1,234.5", "12%", "(5)", "12d", "nan", "inf", "1_000", "0x10", "-2.5", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = {r.s: r.v for r in df.select("s", parse_double("s").alias("v")).collect()}
    assert got["1e3"] == 1000.0 and got[" 12 "] == 12.0 and got["-2.5"] == -2.5 and got[".5"] == 0.5
    for bad in ("$1,234.5", "12%", "(5)", "12d", "nan", "inf", "1_000", "0x10"):
        assert got[bad] is None


def test_quality_thresholds(spark):
    # exactly half bad passes, one more fails (strict >)
    half = spark.createDataFrame([("2024-01-01", "1"), ("bad", "x")], "order_date string, net_revenue string")
    r = Q.validation_report(half, keys=[]).collect()[0]
    assert r.bad_dates == 1 and r.is_valid
    worse = spark.createDataFrame([("2024-01-01", "1"), ("bad", "x"), ("worse", "y")],
                                  "order_date string, net_revenue string")
    r = Q.validation_report(worse, keys=[]).collect()[0]
    assert not r.is_valid and len(r.errors) == 2
    neg = spark.createDataFrame([("2024-01-01", "-1"), ("2024-01-02", "-3")],
                                "order_date string, net_revenue string")
    r = Q.validation_report(neg, keys=[]).collect()[0]
    assert r.errors == ["Column 'net_revenue' contains only negative values."]


def test_preview_and_duplicates(spark, landing):
    raw, _, _ = CSV.read_sales_files(spark, landing)
    p = CSV.preview(raw, 3).collect()
    assert len(p) == 3 and '"order_date"' in p[0].record
    with pytest.raises(ValueError):
        CSV.preview(raw, 0)
    assert CSV.duplicate_files(spark, landing).count() == 0


def test_preview_summary(spark, landing):
    raw, _, _ = CSV.read_sales_files(spark, landing)
    s = CSV.preview_summary(raw, 2).collect()[0]
    assert s.preview_rows == 2 and s.total_rows == raw.count()
    assert s.columns[0] == "dataset_id" and len(s.data) == 2


def test_quantity_and_unknown_rules(spark):
    df = spark.createDataFrame([("2.7", None), ("-2.7", " West "), (None, "   "), ("x", "NA")],
                               "q string, region string")
    q = [r[0] for r in df.select(CL.coerce_quantity("q")).collect()]
    assert q == [2, -2, 1, 1]
    assert [r[0] for r in df.select(CL.coerce_quantity(None)).collect()] == [1, 1, 1, 1]
    filled = CL.fill_unknown(df.select("region"), ["region", "product"]).collect()
    # NA stays text here: missing-value tokens are the reader's job (clean_text)
    assert [(r.region, r.product) for r in filled] == [
        ("Unknown", "Unknown"), ("West", "Unknown"), ("", "Unknown"), ("NA", "Unknown")]


def test_too_wide_rows(spark, tmp_path):
    d = tmp_path / "wide"
    d.mkdir()
    (d / "w.csv").write_text("date,amount\n2024-01-01,5\n2024-01-02,6,extra\n")
    raw, _, _ = CSV.read_sales_files(spark, str(d), keep_corrupt=True)
    rows = raw.collect()
    assert len(rows) == 2
    assert [r._corrupt_record for r in rows if r._corrupt_record] == ["2024-01-02,6,extra"]
    with pytest.raises(Exception):
        CSV.read_sales_files(spark, str(d), mode="FAILFAST")[0].collect()
