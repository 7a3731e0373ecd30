"""Staging, intermediate and mart models as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.config import Settings
from shelfwatch.functions.money import cents, from_cents, money_avg, money_sum
from shelfwatch.functions.skew import split_join, union_all
from shelfwatch.sources.retail import RawTables
from shelfwatch.sources.tables import write_table

ORDER_COLUMNS = (
    "order_id",
    "customer_id",
    "store_id",
    "order_timestamp",
    "order_date",
    "order_status",
    "channel",
    "country_code",
)
FACT_COLUMNS = (*ORDER_COLUMNS, "order_revenue", "total_quantity")
STORED_FACTS = (
    "order_id bigint, customer_id bigint, store_id bigint, order_timestamp timestamp_ntz, "
    "order_date date, order_status string, channel string, country_code string, "
    "order_revenue double, total_quantity bigint, order_month date"
)


# -- staging ---------------------------------------------------------------


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "first_name",
        "last_name",
        "email",
        "customer_type",
        "country_code",
        F.col("signup_date").cast("date").alias("signup_date"),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    """``customer_id`` is cast once here: a nullable key may arrive as a double."""
    return raw.select(
        "order_id",
        F.col("customer_id").cast("bigint").alias("customer_id"),
        "store_id",
        F.col("order_timestamp").cast("timestamp_ntz").alias("order_timestamp"),
        F.col("order_date").cast("date").alias("order_date"),
        F.col("status").alias("order_status"),
        "channel",
        "country_code",
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_amount")


def stg_products(raw: DataFrame) -> DataFrame:
    return raw.select("product_id", "product_name", "category", "unit_price")


def stg_stores(raw: DataFrame) -> DataFrame:
    return raw.select(
        "store_id", "store_name", "city", "country_code", F.col("channel").alias("store_channel")
    )


def stg_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        "payment_id",
        "order_id",
        "payment_method",
        "payment_status",
        F.col("paid_at").cast("timestamp_ntz").alias("paid_at"),
    )


# -- intermediate ----------------------------------------------------------


def int_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the segment of their customer; unknown customers stay.

    Both sides are plain shuffles, so adaptive execution can split a customer
    (or the NULL customer) that holds a large share of the orders.
    """
    segments = customers.select("customer_id", F.col("customer_type").alias("customer_segment"))
    return orders.join(segments, "customer_id", "left").select(
        "order_id", "customer_id", "customer_segment", "order_date", "order_status", "channel"
    )


def counted_orders(settings: Settings) -> Column:
    """Which staged orders count as revenue."""
    accepted = F.col("order_status").isin(*settings.accepted_statuses)
    if settings.exclude_confirmed_from is None:
        return accepted
    before = F.col("order_date") < F.lit(settings.exclude_confirmed_from)
    return accepted & (before | (F.col("order_status") != settings.excluded_status))


def order_amounts(items: DataFrame) -> DataFrame:
    """Amount and quantity per order, in cents and units.

    Items are the largest table. Summing them per order before the join means
    the map side already merges the lines of an order, however many there are.
    """
    return items.groupBy("order_id").agg(
        F.sum(cents("line_amount")).alias("amount_cents"),
        F.sum("quantity").cast("bigint").alias("units"),
    )


def int_order_revenue(
    orders: DataFrame,
    items: DataFrame,
    settings: Settings,
    hot_order_ids: Sequence[Any] = (),
) -> DataFrame:
    """Revenue per distinct order row.

    Copies of an order each join all items of that order, so its revenue counts
    once per copy; copies that agree in all eight columns become one row. The
    grouping keys include the join key, so the second aggregation adds no shuffle.
    """
    branches = split_join(
        orders.where(counted_orders(settings)).select(*ORDER_COLUMNS),
        order_amounts(items),
        "order_id",
        "inner",
        hot_order_ids,
    )
    grouped = [
        branch.groupBy(*ORDER_COLUMNS).agg(
            from_cents(F.sum("amount_cents")).alias("order_revenue"),
            F.sum("units").alias("total_quantity"),
        )
        for branch in branches
    ]
    return union_all(grouped)


def int_customer_orders(customers: DataFrame, revenue: DataFrame) -> DataFrame:
    """Order history per customer; customers without orders keep a row.

    Revenue is reduced to one row per customer first. Its distinct count is
    spread by (customer, order), so a customer with a third of all orders does
    not land in one task.
    """
    history = revenue.where(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("order_count"),
        money_sum("order_revenue").alias("lifetime_revenue"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    joined = customers.select("customer_id").join(history, "customer_id", "left")
    return joined.select(
        "customer_id",
        F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count"),
        F.coalesce("lifetime_revenue", F.lit(0.0)).alias("lifetime_revenue"),
        "first_order_date",
        "last_order_date",
    )


# -- marts -----------------------------------------------------------------


def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", "first_name", "last_name", "email", "country_code", "signup_date"
    )


def dim_products(products: DataFrame) -> DataFrame:
    return products.select("product_id", "product_name", "category", "unit_price")


def dim_stores(stores: DataFrame) -> DataFrame:
    return stores.select("store_id", "store_name", "city", "country_code", "store_channel")


def fct_orders(revenue: DataFrame) -> DataFrame:
    return revenue.select(*FACT_COLUMNS)


def fct_daily_sales(facts: DataFrame) -> DataFrame:
    """Daily totals. The two distinct counts share one pass over the facts and
    are spread by (day, id), so a very busy day is not a single task."""
    return facts.groupBy("order_date").agg(
        F.countDistinct("order_id").alias("order_count"),
        F.countDistinct("customer_id").alias("active_customers"),
        money_sum("order_revenue").alias("total_revenue"),
        money_avg("order_revenue").alias("avg_order_value"),
    )


def order_revenue_positive(
    orders: DataFrame, items: DataFrame, settings: Settings, hot_order_ids: Sequence[Any] = ()
) -> DataFrame:
    """Revenue rows whose order amount is above zero."""
    return int_order_revenue(orders, items, settings, hot_order_ids).where(F.col("order_revenue") > 0)


def revenue_expression(amount: Column, quantity: Column) -> Column:
    """Reusable expression: amount times quantity."""
    return amount * quantity


class Warehouse:
    """All models over one set of raw tables, each built when first used."""

    def __init__(
        self,
        raw: RawTables,
        settings: Settings | None = None,
        hot_order_ids: Callable[[], Sequence[Any]] = tuple,
    ) -> None:
        """``hot_order_ids`` is asked for only when the revenue model is built."""
        self.raw = raw
        self.settings = settings or Settings()
        self.hot_order_ids = hot_order_ids

    @cached_property
    def stg_customers(self) -> DataFrame:
        return stg_customers(self.raw.customers)

    @cached_property
    def stg_orders(self) -> DataFrame:
        return stg_orders(self.raw.orders)

    @cached_property
    def stg_order_items(self) -> DataFrame:
        return stg_order_items(self.raw.order_items)

    @cached_property
    def stg_products(self) -> DataFrame:
        return stg_products(self.raw.products)

    @cached_property
    def stg_stores(self) -> DataFrame:
        return stg_stores(self.raw.stores)

    @cached_property
    def stg_payments(self) -> DataFrame:
        return stg_payments(self.raw.payments)

    @cached_property
    def int_orders(self) -> DataFrame:
        return int_orders(self.stg_orders, self.stg_customers)

    @cached_property
    def int_order_revenue(self) -> DataFrame:
        return int_order_revenue(
            self.stg_orders, self.stg_order_items, self.settings, self.hot_order_ids()
        )

    @cached_property
    def int_customer_orders(self) -> DataFrame:
        return int_customer_orders(self.stg_customers, self.int_order_revenue)

    @cached_property
    def dim_customers(self) -> DataFrame:
        return dim_customers(self.stg_customers)

    @cached_property
    def dim_products(self) -> DataFrame:
        return dim_products(self.stg_products)

    @cached_property
    def dim_stores(self) -> DataFrame:
        return dim_stores(self.stg_stores)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return fct_orders(self.int_order_revenue)

    @cached_property
    def fct_daily_sales(self) -> DataFrame:
        return fct_daily_sales(self.fct_orders)

    VIEWS = (
        "stg_customers",
        "stg_orders",
        "stg_order_items",
        "stg_products",
        "stg_stores",
        "stg_payments",
        "int_orders",
        "int_order_revenue",
        "int_customer_orders",
    )
    MARTS = ("dim_customers", "dim_products", "dim_stores", "fct_orders", "fct_daily_sales")

    def register_views(self) -> None:
        """Expose raw tables and all models to SQL as temporary views."""
        self.raw.register()
        for name in (*self.VIEWS, *self.MARTS):
            getattr(self, name).createOrReplaceTempView(name)

    def use_stored_facts(self, path: str, mode: str = "errorifexists") -> Warehouse:
        """Store the order facts once and let every later model read them back.

        The facts feed the daily mart, the customer history and all dashboard
        queries. As a view they would repeat the largest join for each reader.
        """
        stored = write_facts(self.fct_orders, path, mode)
        copy = Warehouse(self.raw, self.settings, self.hot_order_ids)
        copy.__dict__["fct_orders"] = stored
        copy.__dict__["int_order_revenue"] = stored
        return copy

    def write_marts(self, folder: str, mode: str = "errorifexists") -> dict[str, DataFrame]:
        """Write every mart below ``folder``, facts first, and return the scans."""
        ready = self.use_stored_facts(f"{folder}/fct_orders", mode)
        written = {"fct_orders": ready.fct_orders}
        for name in self.MARTS:
            if name != "fct_orders":
                written[name] = write_table(getattr(ready, name), f"{folder}/{name}", mode=mode)
        return written


def write_facts(facts: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Store order facts by month, so a date range reads only its months."""
    by_month = facts.withColumn("order_month", F.trunc("order_date", "MM"))
    return write_table(by_month, path, partition_by="order_month", mode=mode)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_FACTS).parquet(path)
