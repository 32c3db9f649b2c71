import os

import pytest

from tillsight.plans import ingest as IN
from tillsight.sources import stores


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "good.csv").write_text('Date,Amount,Note\n2024-01-02,4,"two\nlines"\n2024-01-03,6,b\nbad,7,c\n2024-01-04,1,x,too wide\n')
    (d / "twin.csv").write_text('Date,Amount,Note\n2024-01-02,4,"two\nlines"\n2024-01-03,6,b\nbad,7,c\n')
    (d / "dates.csv").write_text("Date,Amount\nsoon,4\nlater,6\n2024-01-01,1\n")
    (d / "columns.csv").write_text("When,Amount\n1,4\n2,6\n")
    (d / "head.csv").write_text("Date,Amount\n")
    (d / "book.xlsx").write_bytes(b"PK")
    (d / "nothing.csv").write_bytes(b"")
    return str(d)


def _state(spark, store):
    sales = sorted(map(tuple, spark.read.parquet(store.sales).select("file_id", "order_date", "net_revenue").collect()))
    return sales, sorted((r.id, r.original_name, r.row_count) for r in stores.read_manifest(spark, store.manifest).collect())


def test_outcome_and_tables(spark, folder, tmp_path):
    store = IN.Store(str(tmp_path / "store"))
    out = {r.file_name: r for r in IN.ingest(spark, folder, store).collect()}
    assert {n for n, r in out.items() if r.accepted} == {"good.csv", "twin.csv"}
    assert out["good.csv"].message == "Successfully uploaded 'good.csv' — 3 rows ready for analysis."
    assert out["dates.csv"].message == "Data quality issues in 'dates.csv': Column 'Date' has too many unparseable dates (2/3 rows)."
    assert out["columns.csv"].message.startswith("Data quality issues in 'columns.csv': Missing required columns: order_date.")
    assert "no data rows" in out["head.csv"].message and "extension" in out["book.xlsx"].message and "empty file" in out["nothing.csv"].message
    sales, manifest = _state(spark, store)
    assert len(sales) == 4 and [m[1:] for m in sorted(manifest, key=lambda m: m[1])] == [("good.csv", 3), ("twin.csv", 3)]
    assert out["good.csv"].file_id != out["twin.csv"].file_id
    assert [r.fields[-1] for r in spark.read.parquet(store.rejects).collect()] == ["too wide"]
    one = stores.load_dataset(spark, store.sales, stores.read_manifest(spark, store.manifest), out["good.csv"].file_id)
    assert one.count() == 2


def test_a_broken_batch_is_invisible_and_can_be_repeated(spark, folder, tmp_path):
    store = IN.Store(str(tmp_path / "store"))
    batch = IN.stage(spark, folder)
    IN.write_data(batch, store)  # and then the driver is lost
    assert stores.read_manifest(spark, store.manifest).count() == 0
    IN.ingest(spark, folder, store)
    first = _state(spark, store)
    IN.ingest(spark, folder, store)
    assert _state(spark, store) == first and len(first[0]) == 4


def test_purge_takes_deleted_datasets_only(spark, folder, tmp_path):
    store = IN.Store(str(tmp_path / "store"))
    ids = {r.file_name: r.file_id for r in IN.ingest(spark, folder, store).where("accepted").collect()}
    stores.manifest_delete(spark, store.manifest, [ids["good.csv"]])
    assert IN.purge(spark, store) == []  # too young: a reader may still use it
    assert IN.purge(spark, store, 0) == [ids["good.csv"]] and IN.purge(spark, store, 0) == []
    assert os.listdir(store.sales).count(f"file_id={ids['good.csv']}") == 0
    assert spark.read.parquet(store.sales).select("file_id").distinct().collect()[0][0] == ids["twin.csv"]
    # The same file can come again.
    again = {r.file_name: r.file_id for r in IN.ingest(spark, folder, store).where("accepted").collect()}
    assert again == ids and spark.read.parquet(store.sales).count() == 4
    assert stores.read_manifest(spark, store.manifest).count() == 2


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert IN.ingest(spark, str(tmp_path / "in"), IN.Store(str(tmp_path / "s"))).count() == 0
