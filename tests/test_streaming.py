"""Landing-folder stream: availableNow runs pick up new files only."""

import os

from tillsight.streaming import landing


def test_stream_daily_revenue(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    header = ["Date", "Amount", "Item"]
    (src / "a.csv").write_text("Date,Amount,Item\n2024-05-01,10,pen\n2024-05-01,5,ink\n2024-05-02,7,pad\n")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    sales = landing.stream_sales(spark, str(src), header, "yyyy-MM-dd")
    landing.start_daily_revenue(sales, out, ck).awaitTermination()
    got = {str(r.ds): (r.revenue, r.orders) for r in landing.daily_totals(spark, out).collect()}
    assert got == {"2024-05-01": (15.0, 2), "2024-05-02": (7.0, 1)}

    (src / "b.csv").write_text("Date,Amount,Item\n2024-05-02,3,pen\nnot a date,9,pen\n")
    sales = landing.stream_sales(spark, str(src), header, "yyyy-MM-dd")
    landing.start_daily_revenue(sales, out, ck).awaitTermination()
    got = {str(r.ds): (r.revenue, r.orders) for r in landing.daily_totals(spark, out).collect()}
    assert got == {"2024-05-01": (15.0, 2), "2024-05-02": (10.0, 2)}
    assert os.path.isdir(ck)
