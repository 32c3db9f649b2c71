"""A messy text export of the star schema, for the ingest operators.

Each line item becomes one all-text sales row, the way a spreadsheet export
would carry it, with data-dependent defects (no rows are dropped or
sampled): missing-value tokens, text that is not a date or a number,
surrounding blanks, negative amounts.  ``dataset_id`` is the order
priority, so there are several datasets with different defect rates.  The
same derivation is given in SQL (:data:`RAW_SQL`) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .star import read_table


def raw_sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    p = read_table(spark, sf_dir, "part")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey, "left")
         .join(c, o.o_custkey == c.c_custkey, "left")
         .join(geo, c.c_nationkey == geo.n_nationkey, "left"))
    ln, disc, tax = F.col("l_linenumber"), F.col("l_discount"), F.col("l_tax")
    amount = (F.col("l_extendedprice").cast("decimal(18,2)")
              * (F.lit(1) - disc.cast("decimal(4,2)"))).cast("decimal(24,4)").cast("string")
    order_date = (F.when(ln == 7, F.lit("N/A"))
                  .when(disc == 0.0, F.lit(""))
                  .when(tax == 0.08, F.lit("soon"))
                  .otherwise(F.date_format("o_orderdate", "M/d/yyyy")))
    revenue = (F.when((F.col("o_orderpriority") == "5-LOW") & (disc <= 0.06), F.concat(F.lit("$"), amount))
               .when(tax == 0.01, F.lit("NaN"))
               .when(ln == 6, F.concat(F.lit("-"), amount))
               .otherwise(amount))
    quantity = (F.when(F.col("l_returnflag") == "A", F.lit("x"))
                .otherwise(F.col("l_quantity").cast("string")))
    product = (F.when(ln == 2, F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")))
               .when(ln == 3, F.lit("NULL"))
               .otherwise(F.col("p_name")))
    region = (F.when(ln == 4, F.lit(" NA ")).when(ln == 5, F.lit("NA")).otherwise(F.col("r_name")))
    return j.select(
        F.col("o_orderpriority").alias("dataset_id"),
        order_date.alias("order_date"), revenue.alias("net_revenue"), quantity.alias("quantity"),
        product.alias("product"), F.col("p_type").alias("category"), region.alias("region"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_discount").cast("string").alias("discount"))


RAW_SQL = """
raw AS (
  SELECT o.o_orderpriority AS dataset_id,
         CASE WHEN l.l_linenumber = 7 THEN 'N/A' WHEN l.l_discount = 0.0 THEN ''
              WHEN l.l_tax = 0.08 THEN 'soon' ELSE strftime(o.o_orderdate, '%-m/%-d/%Y') END AS order_date,
         CASE WHEN o.o_orderpriority = '5-LOW' AND l.l_discount <= 0.06 THEN '$' || amt
              WHEN l.l_tax = 0.01 THEN 'NaN' WHEN l.l_linenumber = 6 THEN '-' || amt ELSE amt END AS net_revenue,
         CASE WHEN l.l_returnflag = 'A' THEN 'x' ELSE CAST(l.l_quantity AS VARCHAR) END AS quantity,
         CASE WHEN l.l_linenumber = 2 THEN ' ' || p.p_name || '  ' WHEN l.l_linenumber = 3 THEN 'NULL'
              ELSE p.p_name END AS product,
         p.p_type AS category,
         CASE WHEN l.l_linenumber = 4 THEN ' NA ' WHEN l.l_linenumber = 5 THEN 'NA' ELSE g.r_name END AS region,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         CAST(l.l_orderkey AS VARCHAR) AS order_id,
         CAST(l.l_discount AS VARCHAR) AS discount
  FROM (SELECT *, CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                           AS DECIMAL(24,4)) AS VARCHAR) AS amt FROM lineitem) l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g
         ON c.c_nationkey = g.n_nationkey
)"""

# Reader-level cleaning (missing-value tokens, then strip) in SQL.
NULL_TOKENS_SQL = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
                   "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")


def clean_sql(col: str) -> str:
    return (f"regexp_replace(CASE WHEN {col} IN ({NULL_TOKENS_SQL}) THEN NULL ELSE {col} END, "
            f"'^\\s+|\\s+$', '', 'g')")


CLEAN_SQL = f"""
clean AS (
  SELECT dataset_id, {', '.join(f'{clean_sql(c)} AS {c}' for c in (
      'order_date', 'net_revenue', 'quantity', 'product', 'category', 'region',
      'customer_id', 'order_id', 'discount'))}
  FROM raw
),
scores AS (
  SELECT dataset_id,
         COUNT(try_strptime(order_date, '%Y-%m-%d')) AS s0,
         COUNT(try_strptime(order_date, '%m/%d/%Y')) AS s2,
         COUNT(try_strptime(order_date, '%d/%m/%Y')) AS s3
  FROM clean GROUP BY dataset_id
),
parsed AS (
  SELECT c.*,
         CASE WHEN s0 >= s2 AND s0 >= s3 THEN try_strptime(order_date, '%Y-%m-%d')
              WHEN s2 >= s3 THEN try_strptime(order_date, '%m/%d/%Y')
              ELSE try_strptime(order_date, '%d/%m/%Y') END AS ts,
         CASE WHEN regexp_matches(net_revenue, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
              THEN TRY_CAST(trim(net_revenue) AS DOUBLE) END AS rev_num
  FROM clean c JOIN scores s USING (dataset_id)
)"""


def cleaned_sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`raw_sales_text` after reader-level cleaning (tokens, strip)."""
    from ..functions.text import clean_text

    raw = raw_sales_text(spark, sf_dir)
    return raw.select("dataset_id", *[clean_text(c).alias(c) for c in raw.columns if c != "dataset_id"])
