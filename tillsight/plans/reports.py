"""Composite results: the full analytics record and the text summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_double, money_out
from ..operators import aggregates as A


def analytics_payload(src, keys: Sequence[str] = (), top_n: int = 10) -> DataFrame:
    """KPIs plus monthly, top-product, region and category lists, one row per key."""
    if not 1 <= top_n <= 50:
        raise ValueError("top_n must be between 1 and 50")
    o = A.overview(src, keys, top_n)

    def money(x) -> Column:
        return money_out(x["revenue"]).alias("revenue")

    def share(x) -> Column:
        return F.when(F.col("_rev") > 0, F.round(as_double(x["revenue"]) / as_double("_rev") * F.lit(100.0), 1)).otherwise(F.lit(0.0))

    return o.select(
        *keys, F.struct(*A.KPIS).alias("kpis"),
        F.transform("_months", lambda x: F.struct(x["month"].alias("month"), money(x), x["orders"].alias("orders"))).alias("monthly_sales"),
        F.transform("_products", lambda x, i: F.struct(
            x["name"].alias("product"), money(x), x["units"].alias("units_sold"), (i + 1).cast("int").alias("rank"))).alias("top_products"),
        F.transform("_regions", lambda x: F.struct(
            x["name"].alias("region"), money(x), x["orders"].alias("orders"), share(x).alias("percentage"))).alias("region_sales"),
        F.transform("_categories", lambda x: F.struct(
            x["name"].alias("category"), money(x), x["units"].alias("units_sold"))).alias("category_sales"))


def payload_items(payload: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The lists of a payload as rows: ``section, pos, label, revenue, amount, percentage``.

    ``amount`` is order rows or units sold, ``percentage`` the region's share.
    """
    def rows(name: str, label: str, amount: str, percentage: str | None = None) -> Column:
        return F.transform(name, lambda x, i: F.struct(
            F.lit(name).alias("section"), i.cast("int").alias("pos"), x[label].alias("label"), x["revenue"].alias("revenue"),
            x[amount].alias("amount"), (x[percentage] if percentage else F.lit(None).cast("double")).alias("percentage")))

    items = F.concat(rows("monthly_sales", "month", "orders"), rows("top_products", "product", "units_sold"),
                     rows("region_sales", "region", "orders", "percentage"), rows("category_sales", "category", "units_sold"))
    return payload.select(*keys, F.inline(items))


def summary_text(src, keys: Sequence[str] = ()) -> DataFrame:
    """One sentence per key: period, orders, revenue, AOV, tops and growth.

    Growth reads "grew" only when it is > 0; zero reads "declined 0.0%";
    no growth figure leaves that part empty.
    """
    keys = list(keys)
    j = A.overview(src, keys).withColumns({"_first": F.try_element_at("_months", F.lit(1))["month"],
                                           "_last": F.try_element_at("_months", F.lit(-1))["month"]})
    period = F.coalesce(F.concat(F.col("_first"), F.lit(" to "), F.col("_last")), F.lit("N/A"))
    growth = F.when(
        F.col("revenue_growth").isNotNull(),
        F.concat(F.lit("Revenue "),
                 F.when(F.col("revenue_growth") > 0, F.lit("grew")).otherwise(F.lit("declined")),
                 F.lit(" "), F.format_string("%.1f", F.round(F.abs("revenue_growth"), 1)),
                 F.lit("% month-over-month."))).otherwise(F.lit(""))
    # The sentence wording.
    text = F.concat(
        F.lit("Dataset covers "), period, F.lit(" with "), F.format_number("total_orders", 0),
        F.lit(" orders generating $"), F.format_number("total_revenue", 2),
        F.lit(" in revenue. Average order value is $"), F.format_number("avg_order_value", 2),
        F.lit(". Top product: "), F.coalesce("top_product", F.lit("N/A")),
        F.lit(". Strongest region: "), F.coalesce("top_region", F.lit("N/A")),
        F.lit(". "), growth)
    return j.select(*keys, text.alias("summary"))
