"""Results do not depend on how Spark partitions the work."""

import pytest

from tillsight.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ("kpis", "monthly_sales", "top_products", "region_sales", "features", "normalize_sales",
         "validation_report")


def _rows(spark, name):
    return sorted(map(tuple, catalog.queries()[name](spark, SF).collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_any_partitioning(spark, name):
    base = _rows(spark, name)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes",
                                          "spark.sql.adaptive.enabled")}
    try:
        for parts, split, aqe in ((1, "128MB", "true"), (17, "16KB", "false"), (4, "64KB", "true")):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            assert _rows(spark, name) == base, (parts, split, aqe)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
