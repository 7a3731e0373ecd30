"""Parameterised dashboard queries over the order facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.money import cents, from_cents, money_avg, money_sum

# Allowed breakdowns and the lengths of the two rankings.
BREAKDOWNS = ("country_code", "channel")
TOP_PRODUCTS = 15
TOP_STORES = 10


@dataclass(frozen=True)
class Filters:
    """Date range (both ends included) and optional value lists.

    An empty list means "no condition", which keeps rows with NULL; a list that
    names every value drops them.
    """

    start: date
    end: date
    countries: Sequence[str] = ()
    channels: Sequence[str] = ()

    def condition(self) -> Column:
        parts = [F.col("order_date").between(F.lit(self.start), F.lit(self.end))]
        if self.countries:
            parts.append(F.col("country_code").isin(*self.countries))
        if self.channels:
            parts.append(F.col("channel").isin(*self.channels))
        return reduce(lambda a, b: a & b, parts)

    def apply(self, facts: DataFrame) -> DataFrame:
        """Filter the facts; stored facts also prune their monthly folders."""
        if "order_month" in facts.columns:
            first, last = self.start.replace(day=1), self.end.replace(day=1)
            facts = facts.where(F.col("order_month").between(F.lit(first), F.lit(last)))
        return facts.where(self.condition())


def with_default_dates(
    facts: DataFrame,
    start: date | None,
    end: date | None,
    countries: Sequence[str] = (),
    channels: Sequence[str] = (),
) -> Filters:
    """Fill missing dates from the facts; reads them only if a date is missing."""
    if start is None or end is None:
        bounds = facts.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi")).first()
        start, end = start or bounds["lo"], end or bounds["hi"]
    return Filters(start, end, tuple(countries), tuple(channels))


def filter_bounds(facts: DataFrame, daily_sales: DataFrame) -> DataFrame:
    """First and last day of the facts, and the refresh day: the last one of the daily mart, which may lag."""
    days = facts.agg(F.min("order_date").alias("min_date"), F.max("order_date").alias("max_date"))
    return days.withColumn("data_refresh_date", daily_sales.agg(F.max("order_date")).scalar())


def filter_values(facts: DataFrame, column: str) -> DataFrame:
    return facts.select(column).distinct().orderBy(F.asc_nulls_last(column))


def kpis(facts: DataFrame, filters: Filters) -> DataFrame:
    """One row of totals, also when no order matches."""
    return filters.apply(facts).agg(
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("customer_id").alias("active_customers"),
        F.coalesce(money_sum("order_revenue"), F.lit(0.0)).alias("revenue"),
        F.coalesce(money_avg("order_revenue"), F.lit(0.0)).alias("avg_basket"),
    )


def daily_trends(facts: DataFrame, filters: Filters) -> DataFrame:
    return (
        filters.apply(facts)
        .groupBy("order_date")
        .agg(F.countDistinct("order_id").alias("orders"), money_sum("order_revenue").alias("revenue"))
        .orderBy(F.asc_nulls_last("order_date"))
    )


def breakdown(facts: DataFrame, dimension: str, filters: Filters) -> DataFrame:
    """Revenue and row count per value of an allowed dimension."""
    if dimension not in BREAKDOWNS:
        raise ValueError("Unsupported breakdown")
    return (
        filters.apply(facts)
        .groupBy(dimension)
        .agg(money_sum("order_revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last(dimension))
    )


def top_products(
    facts: DataFrame, items: DataFrame, products: DataFrame, filters: Filters, limit: int = TOP_PRODUCTS
) -> DataFrame:
    """Best-selling products by revenue.

    Items are summed per product right after they meet their orders, so the
    product table joins one row per product and not one per item. The name and
    category break ties, which keeps the cut-off reproducible.
    """
    per_product = (
        filters.apply(facts)
        .select("order_id")
        .join(items.select("order_id", "product_id", "line_amount", "quantity"), "order_id")
        .groupBy("product_id")
        .agg(F.sum(cents("line_amount")).alias("amount_cents"), F.sum("quantity").alias("sold"))
    )
    return (
        per_product.join(products.select("product_id", "product_name", "category"), "product_id")
        .groupBy("product_name", "category")
        .agg(from_cents(F.sum("amount_cents")).alias("revenue"), F.sum("sold").alias("units"))
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("product_name"), F.asc_nulls_last("category"))
        .limit(limit)
    )


def top_stores(facts: DataFrame, stores: DataFrame, filters: Filters, limit: int = TOP_STORES) -> DataFrame:
    """Best stores by revenue; facts are summed per store before the join."""
    per_store = (
        filters.apply(facts)
        .groupBy("store_id")
        .agg(F.sum(cents("order_revenue")).alias("amount_cents"), F.count(F.lit(1)).alias("order_rows"))
    )
    return (
        per_store.join(stores.select("store_id", "store_name", "country_code"), "store_id")
        .groupBy("store_name", "country_code")
        .agg(from_cents(F.sum("amount_cents")).alias("revenue"), F.sum("order_rows").alias("orders"))
        .orderBy(F.desc_nulls_last("revenue"), F.asc_nulls_last("store_name"), F.asc_nulls_last("country_code"))
        .limit(limit)
    )
