"""Sales sources: where the canonical sales facts come from.

Every analytic operator reads *facts*: the dimension columns it groups on
plus three additive measures

* ``net_revenue`` - exact DECIMAL money,
* ``quantity``    - units (BIGINT),
* ``line_count``  - number of sales rows ("orders" in the KPIs).

A raw canonical table has ``line_count = 1`` per row.  A source may also
hand out facts that are already partially aggregated at a coarser grain;
because every measure is a sum, operators give the same answer either way.
This lets a star-schema source aggregate the fact table *before* each
dimension join, which keeps shuffles small and collapses hot keys map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DecimalType

from ..functions.numbers import MONEY

# Canonical dimension names.
DIMENSIONS = ("order_date", "product", "category", "region", "customer_id")
MEASURES = ("net_revenue", "quantity", "line_count")


def check_dims(dims: Sequence[str], extra: Sequence[str] = ()) -> list[str]:
    out = []
    for d in dims:
        if d not in DIMENSIONS and d not in extra:
            raise ValueError(f"unknown sales dimension {d!r}; known: {DIMENSIONS + tuple(extra)}")
        if d not in out:
            out.append(d)
    return out


def measure_sums() -> list:
    """Re-aggregation of the additive measures."""
    return [
        F.sum("net_revenue").alias("net_revenue"),
        F.sum("quantity").alias("quantity"),
        F.sum("line_count").alias("line_count"),
    ]


class SalesSource:
    """Base class: ``facts(dims)`` returns dims + MEASURES."""

    #: extra pass-through key columns (e.g. ``dataset_id``) a source offers.
    keys: tuple[str, ...] = ()

    def facts(self, dims: Sequence[str] = ()) -> DataFrame:  # pragma: no cover
        raise NotImplementedError

    @property
    def spark(self):  # pragma: no cover
        raise NotImplementedError


class CanonicalSales(SalesSource):
    """Facts from a table already in canonical form (one row per sale).

    Expected columns: ``order_date`` TIMESTAMP (non-null), ``net_revenue``
    numeric, and optionally ``quantity``, ``product``, ``category``,
    ``region``, ``customer_id`` and any key columns.  ``line_count`` is 1
    unless the table carries it already.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str] = ()):
        self.df = df
        self.keys = tuple(keys)

    @property
    def spark(self):
        return self.df.sparkSession

    def facts(self, dims: Sequence[str] = ()) -> DataFrame:
        dims = check_dims(dims, self.keys)
        cols = self.df.columns
        out = []
        for d in dims:
            out.append(F.col(d) if d in cols else F.lit("Unknown").alias(d))
        rev = F.col("net_revenue")
        # Text or floating input becomes exact money; decimals (possibly
        # already summed, wider than MONEY) are kept as they are.
        is_dec = isinstance(self.df.schema["net_revenue"].dataType, DecimalType)
        out.append((rev if is_dec else rev.try_cast(MONEY)).alias("net_revenue"))
        out.append((F.col("quantity") if "quantity" in cols else F.lit(1)).cast("bigint").alias("quantity"))
        out.append((F.col("line_count") if "line_count" in cols else F.lit(1)).cast("bigint").alias("line_count"))
        return self.df.select(*out)
