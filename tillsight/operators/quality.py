"""Data-quality checks on canonical text columns, in one aggregate pass.

:func:`validation_report` computes, per dataset, the row and column counts,
unparseable dates, non-numeric revenue, the all-negative flag and the date
range in a single ``groupBy``; the error messages are then a projection of
that one row per dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DATE_FORMATS
from ..functions.numbers import parse_double
from .clean import parse_order_date
from .headers import CANONICAL, REQUIRED

MAX_COLUMNS = 100
MIN_ROWS = 2
MAX_BAD_SHARE = 0.5


# Error messages of the data-quality checks.
def _msg_empty() -> Column:
    return F.lit("The CSV file contains no data rows.")


def _msg_few_rows() -> Column:
    return F.lit("The CSV must contain at least 2 data rows.")


def _msg_wide(n: Column) -> Column:
    return F.format_string("Too many columns (%d). Maximum is 100.", n)


def _msg_bad_dates(col: Column, bad: Column, rows: Column) -> Column:
    return F.format_string("Column '%s' has too many unparseable dates (%d/%d rows).", col, bad, rows)


def _msg_bad_revenue(col: Column, bad: Column, rows: Column) -> Column:
    return F.format_string("Column '%s' has too many non-numeric values (%d/%d rows).", col, bad, rows)


def _msg_negative(col: Column) -> Column:
    return F.format_string("Column '%s' contains only negative values.", col)


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def quality_counts(raw: DataFrame, keys: Sequence[str] = ("dataset_id",), date_format: str | None = None,
                   formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Q1, Q3, Q4, Q5, Q7 figures per key in one aggregate."""
    keys = [k for k in keys if k in raw.columns]
    d = parse_order_date(raw.withColumn("__d", F.col("order_date")), "__d", keys, date_format,
                         out="__ts", formats=formats)
    num = parse_double("net_revenue")
    return _grouped(d, keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("__ts").isNull()).alias("bad_dates"),
        F.count_if(num.isNull()).alias("bad_revenue"),
        F.coalesce(F.bool_and(F.when(num.isNotNull(), num < 0)), F.lit(True)).alias("all_negative"),
        F.to_date(F.min("__ts")).alias("date_start"),
        F.to_date(F.max("__ts")).alias("date_end"),
    )


def validation_report(raw: DataFrame, datasets: DataFrame | None = None, keys: Sequence[str] = ("dataset_id",),
                      date_format: str | None = None) -> DataFrame:
    """One row per dataset: counts, ``errors`` (ARRAY<STRING>) and ``is_valid``.

    ``datasets`` (optional) lists every dataset with ``column_count``,
    ``date_header``, ``revenue_header`` and ``mapped`` (ARRAY of canonical
    names found); datasets without data rows still get a row from it.
    Without it, all canonical columns count as mapped and the headers are
    the canonical names.
    """
    keys = [k for k in keys if k in raw.columns]
    counts = quality_counts(raw, keys, date_format)
    if datasets is None:
        width = len([c for c in raw.columns if c not in keys and not c.startswith("_")])
        r = counts.withColumns({"column_count": F.lit(width), "date_header": F.lit("order_date"),
                                "revenue_header": F.lit("net_revenue"),
                                "mapped": F.array(*[F.lit(c) for c in CANONICAL])})
    else:
        r = datasets.join(counts, keys, "left") if keys else datasets.crossJoin(counts)
    rows = F.coalesce(F.col("row_count"), F.lit(0)).cast("bigint")
    bad_d = F.coalesce(F.col("bad_dates"), F.lit(0))
    bad_r = F.coalesce(F.col("bad_revenue"), F.lit(0))
    missing = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), F.col("mapped"))
    has_date = F.array_contains("mapped", "order_date")
    has_rev = F.array_contains("mapped", "net_revenue")
    checks = F.array(
        F.when(rows < MIN_ROWS, _msg_few_rows()),
        F.when(F.col("column_count") > MAX_COLUMNS, _msg_wide(F.col("column_count"))),
        F.when(has_date & (bad_d > rows * MAX_BAD_SHARE), _msg_bad_dates(F.col("date_header"), bad_d, rows)),
        F.when(has_rev & (bad_r > rows * MAX_BAD_SHARE), _msg_bad_revenue(F.col("revenue_header"), bad_r, rows))
         .when(has_rev & F.coalesce(F.col("all_negative"), F.lit(True)), _msg_negative(F.col("revenue_header"))),
    )
    errors = F.when(rows == 0, F.array(_msg_empty())).otherwise(F.filter(checks, lambda x: x.isNotNull()))
    out = r.select(
        *keys, rows.alias("row_count"), F.col("column_count").cast("int").alias("column_count"),
        missing.alias("missing_required"), bad_d.cast("bigint").alias("bad_dates"),
        bad_r.cast("bigint").alias("bad_revenue"), "date_start", "date_end", errors.alias("errors"))
    return out.withColumn("is_valid", (F.size("missing_required") == 0) & (F.size("errors") == 0))


def null_counts(raw: DataFrame, columns: Sequence[str] | None = None,
                keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """``(keys..., column, nulls)``: one aggregate pass, then ``stack``."""
    keys = [k for k in keys if k in raw.columns]
    columns = [c for c in (columns or raw.columns) if c not in keys and not c.startswith("_")]
    agg = _grouped(raw, keys).agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}")
                                    for i, c in enumerate(columns)])
    pairs = ", ".join(f"'{c}', n{i}" for i, c in enumerate(columns))
    return agg.select(*keys, F.expr(f"stack({len(columns)}, {pairs}) AS (column, nulls)"))


def ingest_message(file_name: Column, rows: Column) -> Column:
    """Fixed value: the upload confirmation sentence."""
    return F.concat(F.lit("Successfully uploaded '"), file_name, F.lit("' — "),
                    F.format_number(rows, 0), F.lit(" rows ready for analysis."))


def enforce(report: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Datasets that pass (batch form of Q9; join or semi-join the data on it)."""
    return report.where("is_valid").select(*keys)


def raise_if_invalid(report: DataFrame, name: str, keys: Sequence[str] = ("dataset_id",)) -> None:
    """Single-upload form of Q9: ValueError with all problems joined by ' | '.

    Collects only failing datasets' messages (one row per dataset).
    """
    bad = failures(report, keys).select("message").collect()
    if bad:
        raise ValueError(f"Data quality issues in '{name}': " + " | ".join(r.message for r in bad))


def failures(report: DataFrame, keys: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Failing datasets with one message joining all their problems."""
    missing = F.when(F.size("missing_required") > 0, F.concat(
        F.lit("Missing required columns: "), F.concat_ws(", ", "missing_required"), F.lit(".")))
    return report.where(~F.col("is_valid")).select(
        *keys, F.concat_ws(" | ", F.array_compact(F.concat(F.array(missing), F.col("errors")))).alias("message"))
