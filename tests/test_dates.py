from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillsight.functions import dates as D

GOOD = {
    "2024-1-5": datetime(2024, 1, 5), "1/5/24": datetime(2024, 1, 5), "1/5/2024 2:30 PM": datetime(2024, 1, 5, 14, 30),
    "January 5, 2024": datetime(2024, 1, 5), "2024-01-05T10:00:00Z": datetime(2024, 1, 5, 10), "2024-01-05": datetime(2024, 1, 5),
    "2024-01-05 23:59:59.123456": datetime(2024, 1, 5, 23, 59, 59, 123456), "2024-01-05T10:00:00+05:30": datetime(2024, 1, 5, 4, 30),
    "2024-01-05T23:00:00-0200": datetime(2024, 1, 6, 1), "2024/1/5 7:08": datetime(2024, 1, 5, 7, 8), "20240105": datetime(2024, 1, 5),
    "5 Jan 2024": datetime(2024, 1, 5), "05-Jan-2024": datetime(2024, 1, 5), "Sept 5, 2024": datetime(2024, 9, 5), "5th March 2024": datetime(2024, 3, 5),
    "Dec. 31, 1999 12:00 am": datetime(1999, 12, 31), "1-5-2024": datetime(2024, 1, 5), "5.1.2024": datetime(2024, 1, 5), "1/5/70": datetime(1970, 1, 5),
    " 1/5/2024 ": datetime(2024, 1, 5), "2024-02-29": datetime(2024, 2, 29), "1/5/2024 12:15 PM": datetime(2024, 1, 5, 12, 15),
}
BAD = [None, "", "soon", "2024-13-01", "2023-02-29", "13/13/2024", "Mayday 5, 2024", "1/5/2024 13:00 PM", "1/5/2024 25:00", "2024-01", "5", "2024-01-05x", "1/5-2024", "32 Jan 2024", "1/5/123"]


def test_shapes(spark):
    values = [*GOOD.items(), *((b, None) for b in BAD)]
    df = spark.createDataFrame([(v,) for v, _ in values], "v string")
    got = df.select("v", D.parse_shape("v").cast("timestamp_ntz").alias("t")).collect()
    assert [(r.v, r.t) for r in got] == values


@pytest.mark.parametrize("seed", [0, 1])
def test_order_is_decided_per_dataset(spark, seed):
    rows = [("us", "1/5/2024"), ("us", "1/25/2024"), ("us", "25/1/2024"), ("us", "12/31/24"), ("eu", "5/1/2024"), ("eu", "25/1/2024"),
            ("eu", "January 5, 2024"), ("none", "3/4/2024"), ("iso", "2024-01-05"), ("eu", "2024-01-05T10:00:00Z"), (None, "1/5/2024")]
    df = spark.createDataFrame(rows, "d string, v string").repartition(3 + seed)
    out = {(r.d, r.v): r.t for r in D.parse_dates(df, "v", "t", ["d"]).withColumn("t", F.col("t").cast("timestamp_ntz")).collect()}
    assert len(out) == len(rows)
    assert out["us", "1/5/2024"] == out["eu", "5/1/2024"] == datetime(2024, 1, 5)
    assert out["us", "25/1/2024"] is None and out["eu", "25/1/2024"] == datetime(2024, 1, 25)
    assert out["none", "3/4/2024"] == datetime(2024, 3, 4) and out["eu", "2024-01-05T10:00:00Z"] == datetime(2024, 1, 5, 10)


def test_one_order_without_keys(spark):
    df = spark.createDataFrame([("25/12/2024",), ("1/2/2024",)], "v string")
    assert [str(r.t)[:10] for r in D.parse_dates(df, "v", "t").orderBy("t").collect()] == ["2024-02-01", "2024-12-25"]
