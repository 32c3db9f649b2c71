import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillsight.session import build_session

    s = build_session("local[4]", 8)
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillsight-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sales8(spark):
    """Eight invented sales over three months, five customers."""
    from datetime import datetime

    rows = [
        ("A1", datetime(2023, 4, 3), "C01", "Lamp", "Home", "Coast", 2, "120.50"),
        ("A2", datetime(2023, 4, 9), "C02", "Kettle", "Kitchen", "Hills", 1, "45.00"),
        ("A3", datetime(2023, 4, 21), "C01", "Rug", "Home", "Plains", 1, "210.00"),
        ("A4", datetime(2023, 5, 2), "C03", "Lamp", "Home", "Coast", 3, "180.75"),
        ("A5", datetime(2023, 5, 14), "C04", "Kettle", "Kitchen", "Valley", 2, "90.00"),
        ("A6", datetime(2023, 5, 30), "C02", "Mug", "Kitchen", "Hills", 6, "36.00"),
        ("A7", datetime(2023, 6, 6), "C05", "Rug", "Home", "Plains", 1, "199.00"),
        ("A8", datetime(2023, 6, 18), "C03", "Mug", "Kitchen", "Valley", 4, "24.00"),
    ]
    return spark.createDataFrame(
        rows, "order_id string, order_date timestamp, customer_id string, product string, "
              "category string, region string, quantity int, net_revenue string"
    ).withColumn("net_revenue", __import__("pyspark.sql.functions", fromlist=["col"]).col("net_revenue")
                 .cast("decimal(24,4)"))
