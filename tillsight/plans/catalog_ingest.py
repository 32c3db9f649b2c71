"""Registered queries of the CSV reader: files written from ``orders``, read back record by record."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.clean import parse_order_date
from ..session import ensure_checkpoint_dir
from ..sources import csv_records as CR
from ..sources.csv_files import duplicate_files
from ..sources.star import read_table
from .catalog import register
from .ingest import Store, ingest


def _order_files(spark, d) -> str:
    """A folder of CSV files of all orders: notes with commas, quotes and newlines, an unmapped column, empty fields."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    o = read_table(spark, d, "orders")
    note = (F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("first line\nsaid \""), "o_orderpriority", F.lit("\", twice\n\nend")))
            .when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")))
    o.select(F.col("o_orderkey").alias("Order"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Sale Date"),
             F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Amount"), note.alias("Note"),
             F.col("o_orderstatus").alias("Clerk, code")).write.option("header", True).option("escape", '"').csv(path)
    return path


_ORDER_SQL = """
WITH lines AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS net_revenue,
         CASE o_orderkey % 3 WHEN 0 THEN 'first line' || chr(10) || 'said "' || o_orderpriority || '", twice' || chr(10) || chr(10) || 'end'
                             WHEN 1 THEN o_orderpriority END AS note,
         o_orderstatus AS code
  FROM orders)"""


def _scan(spark, d):
    records, _, files = CR.scan_csv(spark, [_order_files(spark, d)])
    rows = CR.sales_columns(records, files)
    return rows.select("order_id", "order_date", "net_revenue", F.col("other")["Note"].alias("note"), F.col("other")["Clerk, code"].alias("code"),
                       F.col("_n_columns").alias("n_columns"))


register("scan_csv", _ORDER_SQL + """
SELECT *, 5 AS n_columns FROM lines""")(_scan)


def _nulls(spark, d):
    records, _, _ = CR.scan_csv(spark, [_order_files(spark, d)])
    by_file = CR.column_nulls(records)
    return by_file.groupBy("pos", "column").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"))


register("csv_column_nulls", _ORDER_SQL + """,
cells AS (
  SELECT unnest(range(5))::INTEGER AS pos, unnest(['Order', 'Sale Date', 'Amount', 'Note', 'Clerk, code']) AS "column",
         unnest([order_id, order_date, net_revenue, note, code]) AS v FROM lines)
SELECT pos, "column", COUNT(*) AS n_rows, COUNT(*) - COUNT(v) AS n_null FROM cells GROUP BY ALL""")(_nulls)


# ----------------------------------------------------------------- S10 T4
def _preview(spark, d):
    """The first ten records of each of eight files of orders, in the order of the files."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    o = read_table(spark, d, "orders").withColumn("file", F.col("o_orderkey") % 8)
    note = F.concat(F.lit("first line\nsaid \""), "o_orderpriority", F.lit("\", twice\n\nend"))
    o.repartition("file").sortWithinPartitions("file", "o_orderkey").select(
        "file", F.col("o_orderkey").alias("Order"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Sale Date"), note.alias("Note"),
    ).write.partitionBy("file").option("header", True).option("escape", '"').csv(path)
    records, _, _ = CR.scan_csv(spark, [path])
    first = CR.first_records(records, 10).withColumn("cell", F.map_from_arrays("labels", "fields"))
    return first.select(F.regexp_extract("dataset_id", r"file=(\d+)", 1).cast("int").alias("file"), F.col("n").cast("int").alias("n"),
                        F.array_join("labels", "|").alias("columns"), F.col("cell")["Order"].alias("order_id"),
                        F.col("cell")["Sale Date"].alias("sale_date"), F.col("cell")["Note"].alias("note"))


register("preview", """
WITH o AS (SELECT *, CAST(o_orderkey % 8 AS INTEGER) AS file FROM orders),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY file ORDER BY o_orderkey) AS INTEGER) AS n FROM o)
SELECT file, n, 'Order|Sale Date|Note' AS columns, CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS sale_date,
       'first line' || chr(10) || 'said "' || o_orderpriority || '", twice' || chr(10) || chr(10) || 'end' AS note
FROM r WHERE n <= 10""")(_preview)


# --------------------------------------------------------------------- P1
def _spellings(spark, d):
    """Order dates as text: each priority a dataset of its own habits, the third one day first, spellings by order key."""
    o = read_table(spark, d, "orders")
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    third = F.col("o_orderpriority").startswith("3")
    text = (F.when(k == 0, F.date_format(day, "yyyy-M-d")).when(k == 1, F.when(third, F.date_format(day, "d/M/yy")).otherwise(F.date_format(day, "M/d/yy")))
            .when(k == 2, F.concat(F.when(third, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "M/d/yyyy")), F.lit(" 2:30 PM")))
            .when(k == 3, F.date_format(day, "MMMM d, yyyy")).when(k == 4, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00:00Z")))
            .when(k == 5, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 23:30:15.25-01:00"))).otherwise(F.lit("not yet")))
    df = o.select("o_orderkey", F.col("o_orderpriority").alias("dataset_id"), text.alias("order_date"))
    out = parse_order_date(df, keys=["dataset_id"])
    return out.select("o_orderkey", "dataset_id", F.col("order_date").cast("timestamp_ntz").alias("order_date"))


register("date_spellings", """
SELECT o_orderkey, o_orderpriority AS dataset_id,
       CASE o_orderkey % 7 WHEN 2 THEN d + INTERVAL '14 hours 30 minutes' WHEN 4 THEN d + INTERVAL '10 hours'
            WHEN 5 THEN d + INTERVAL '24 hours 30 minutes 15 seconds 250 milliseconds' WHEN 6 THEN NULL ELSE d END AS order_date
FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders)""")(_spellings)


# ------------------------------------------------------- S4 S5 Q9 S11
def _batches(spark, d):
    """Orders as forty files, some of them unfit, taken in as one batch."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    o = read_table(spark, d, "orders").withColumn("batch", F.col("o_orderkey") % 40)
    kind = F.col("batch") % 10
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    o.repartition("batch").select(
        "batch", F.when(kind == 3, F.lit("soon")).otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("Sale Date"),
        F.when(kind == 4, F.lit("x")).when(kind == 5, F.concat(F.lit("-"), amount)).otherwise(amount).alias("Amount"),
        F.concat(F.lit("a \"note\",\nof two lines "), "o_orderpriority").alias("Note"),
    ).write.partitionBy("batch").option("header", True).option("escape", '"').csv(f"{base}/in")
    out = ingest(spark, f"{base}/in", Store(f"{base}/store"))
    batch = F.regexp_extract("path", r"batch=(\d+)", 1).cast("int")
    return out.select(batch.alias("batch"), "accepted", "row_count", F.regexp_replace("message", "'part-[^']*'", "'file'").alias("message"))


register("ingest_batch", """
WITH b AS (SELECT CAST(o_orderkey % 40 AS INTEGER) AS batch, COUNT(*) AS n FROM orders GROUP BY 1),
p AS (SELECT *, concat_ws(' | ', CASE WHEN n < 2 THEN 'The CSV must contain at least 2 data rows.' END,
    CASE batch % 10 WHEN 3 THEN 'Column ''Sale Date'' has too many unparseable dates (' || n || '/' || n || ' rows).'
                    WHEN 4 THEN 'Column ''Amount'' has too many non-numeric values (' || n || '/' || n || ' rows).'
                    WHEN 5 THEN 'Column ''Amount'' contains only negative values.' END) AS e FROM b)
SELECT batch, e = '' AS accepted, CAST(n AS BIGINT) AS row_count,
       CASE WHEN e = '' THEN 'Successfully uploaded ''file'' — ' || format('{:,}', n) || ' rows ready for analysis.'
            ELSE 'Data quality issues in ''file'': ' || e END AS message
FROM p""")(_batches)


# --------------------------------------------------------------------- S9
def _equal_files(spark, d):
    """Orders as eight files: 0 to 3 by order key, and 4 to 7 the same again but for one more day in file 5."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    o = read_table(spark, d, "orders")
    o = o.select("o_orderkey", "o_orderdate", "o_orderstatus", F.explode(F.array(F.lit(0), F.lit(4))).alias("copy"))
    o = o.withColumn("file", F.col("o_orderkey") % 4 + F.col("copy"))
    day = F.when(F.col("file") == 5, F.date_add("o_orderdate", 1)).otherwise(F.to_date("o_orderdate"))
    o = o.withColumn("day", day).repartition("file").sortWithinPartitions("file", "o_orderkey")
    o.select("file", "o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "o_orderstatus").write.partitionBy("file").csv(path)
    out = duplicate_files(spark, path)
    return out.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("int").alias("file"), F.col("copies").cast("int").alias("copies"))


register("equal_files", """
SELECT DISTINCT CAST(o_orderkey % 4 + c AS INTEGER) AS file, 2 AS copies
FROM orders, (VALUES (0), (4)) AS t(c) WHERE o_orderkey % 4 <> 1""")(_equal_files)
