"""Coercions from canonical *text* columns to the typed sales table.

All of it is one projection after the scan (plus the small date-format
choice per dataset), so it runs inside the scan stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.dates import DATE_FORMATS, month_label, parse_dates
from ..functions.numbers import MONEY, parse_double, parse_money
from ..functions.text import dimension

DIMENSION_COLUMNS = ("product", "category", "region", "customer_id")


# --------------------------------------------------------------------- P1
def parse_order_date(df: DataFrame, column: str = "order_date", keys: Sequence[str] = (),
                     fmt: str | None = None, out: str = "order_date",
                     formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text date -> TIMESTAMP, failures NULL; one format per ``keys`` group."""
    tmp = "__date_text"
    d = df.withColumnRenamed(column, tmp) if column == out else df.withColumn(tmp, F.col(column))
    return parse_dates(d, tmp, out, keys, fmt, formats).drop(tmp)


# --------------------------------------------------------------------- P2
def drop_bad_dates(df: DataFrame, column: str = "order_date",
                   name: str = "dropped_dates") -> tuple[DataFrame, Observation]:
    """Remove NULL dates; the observation reports how many were dropped
    once the result is computed (no extra pass)."""
    obs = Observation(name)
    observed = df.observe(obs, F.count_if(F.col(column).isNull()).alias("dropped"),
                          F.count(F.lit(1)).alias("rows_in"))
    return observed.where(F.col(column).isNotNull()), obs


# --------------------------------------------------------------------- P3
def time_parts(df: DataFrame, column: str = "order_date") -> DataFrame:
    """year, month, year_month ('yyyy-MM') and ISO week number."""
    c = F.col(column)
    return df.withColumns({
        "year": F.year(c), "month": F.month(c),
        "year_month": month_label(c), "week": F.weekofyear(c),
    })


# --------------------------------------------------------------------- P4
def coerce_revenue(c: Column | str) -> Column:
    """Plain number -> exact money; anything else (row kept) -> 0."""
    return F.coalesce(parse_money(c), F.lit(0).cast(MONEY))


# --------------------------------------------------------------------- P5
def coerce_quantity(c: Column | str | None) -> Column:
    """Number truncated toward zero; missing or not a number -> 1."""
    if c is None:
        return F.lit(1).cast("bigint")
    return F.coalesce(parse_double(c).try_cast("bigint"), F.lit(1).cast("bigint"))


# --------------------------------------------------------------------- P6
def fill_unknown(df: DataFrame, columns: Sequence[str] = DIMENSION_COLUMNS) -> DataFrame:
    """Absent or NULL dimension -> 'Unknown'; otherwise stripped text."""
    return df.withColumns({c: dimension(c if c in df.columns else None) for c in columns})


# --------------------------------------------------------------------- P7
def normalize_sales(raw: DataFrame, keys: Sequence[str] = ("dataset_id",), date_format: str | None = None,
                    with_time_parts: bool = False) -> DataFrame:
    """Canonical text columns -> the typed canonical sales table.

    order_date TIMESTAMP (rows whose date does not parse are dropped),
    net_revenue DECIMAL (non-numbers -> 0), quantity BIGINT (-> 1),
    product/category/region/customer_id text ('Unknown' when missing),
    order_id text, discount DOUBLE; ``keys`` columns are kept.
    """
    keys = [k for k in keys if k in raw.columns]
    cols = raw.columns
    d = parse_order_date(raw.withColumn("__d", F.col("order_date").cast("string")), "__d", keys,
                         date_format, out="__ts")
    # Exploding an array of the date drops NULLs and works each date out once; a filter would repeat the parse.
    d = d.withColumn("__ts", F.explode(F.array_compact(F.array("__ts"))))
    out = d.select(
        *keys,
        F.col("__ts").alias("order_date"),
        coerce_revenue("net_revenue").alias("net_revenue"),
        coerce_quantity("quantity" if "quantity" in cols else None).alias("quantity"),
        *[dimension(c if c in cols else None).alias(c) for c in DIMENSION_COLUMNS],
        (F.col("order_id").cast("string") if "order_id" in cols else F.lit(None).cast("string")).alias("order_id"),
        (parse_double("discount") if "discount" in cols else F.lit(None).cast("double")).alias("discount"),
    )
    return time_parts(out) if with_time_parts else out
