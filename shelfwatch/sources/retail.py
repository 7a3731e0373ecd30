"""Raw retail tables, mapped from the order-processing parquet files.

Each function is a narrow projection (at most a join with the 25-row nation
table), so filters and column pruning still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.sources.tables import read_table

# Fixed values of the mapping.
CHANNELS = ("web", "store", "mobile")
PAYMENT_METHODS = ("card", "paypal", "cash")
NATIONS = 25
FIRST_SIGNUP = "1994-01-01"
SIGNUP_DAYS = 400
PAYMENT_HOURS = 72


def _pick(values: tuple[str, ...], position: Column) -> Column:
    """The ``position``-th value, as a CASE that stays in generated code."""
    chosen = F
    for index, value in enumerate(values):
        chosen = chosen.when(position == index, value)
    return chosen


def _two_decimals(value: Column) -> Column:
    """Round half up in plain double arithmetic, the same in every engine."""
    return F.floor(value * 100 + 0.5) / F.lit(100.0)


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "nation").select("n_nationkey", "n_name")


def raw_customers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        read_table(spark, folder, "customer")
        .join(_nations(spark, folder), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("customer_id"),
            F.concat(F.lit("first_"), key).alias("first_name"),
            F.concat(F.lit("last_"), key).alias("last_name"),
            F.concat(F.lit("user"), key, F.lit("@example.com")).alias("email"),
            F.col("n_name").alias("country_code"),
            F.date_add(F.lit(FIRST_SIGNUP).cast("date"), (key % SIGNUP_DAYS).cast("int")).alias("signup_date"),
            F.lower("c_mktsegment").alias("customer_type"),
        )
    )


def raw_products(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
    )


def raw_stores(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read_table(spark, folder, "supplier")
        .join(_nations(spark, folder), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("store_id"),
            F.col("s_name").alias("store_name"),
            F.concat(F.lit("city_"), F.col("s_nationkey")).alias("city"),
            F.col("n_name").alias("country_code"),
            F.when(F.col("s_suppkey") % 2 == 0, "store").otherwise("web").alias("channel"),
        )
    )


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    store_count = read_table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    pending = (
        F.when(priority.isin("1-URGENT", "2-HIGH"), "shipped")
        .when(priority == "3-MEDIUM", "cancelled")
        .otherwise("pending")
    )
    return (
        read_table(spark, folder, "orders")
        .join(_nations(spark, folder), F.col("o_custkey") % NATIONS == F.col("n_nationkey"), "left")
        .select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            (key % store_count).alias("store_id"),
            F.col("o_orderdate").alias("order_timestamp"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.when(status == "F", "completed").when(status == "O", "confirmed").otherwise(pending).alias("status"),
            _pick(CHANNELS, key % len(CHANNELS)).alias("channel"),
            F.col("n_name").alias("country_code"),
        )
    )


def raw_order_items(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _two_decimals(F.try_divide("l_extendedprice", "l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("line_amount"),
    )


def raw_payments(spark: SparkSession, folder: str) -> DataFrame:
    """One payment per order in an accepted state."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    accepted = status.isin("F", "O") | (
        (status == "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    )
    return (
        read_table(spark, folder, "orders")
        .where(accepted)
        .select(
            key.alias("payment_id"),
            key.alias("order_id"),
            _pick(PAYMENT_METHODS, key % len(PAYMENT_METHODS)).alias("payment_method"),
            F.when(key % 50 == 0, "failed").when(key % 50 <= 4, "pending").otherwise("paid").alias("payment_status"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=(key % PAYMENT_HOURS).cast("int"))).alias("paid_at"),
        )
    )


class RawTables:
    """The six raw tables of the warehouse, each opened when first used."""

    LOADERS = {
        "customers": raw_customers,
        "products": raw_products,
        "stores": raw_stores,
        "orders": raw_orders,
        "order_items": raw_order_items,
        "payments": raw_payments,
    }

    def __init__(self, spark: SparkSession, folder: str, **tables: DataFrame) -> None:
        self.spark, self.folder = spark, folder
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.LOADERS:
            raise AttributeError(name)
        if name not in self._tables:
            self._tables[name] = self.LOADERS[name](self.spark, self.folder)
        return self._tables[name]

    def with_tables(self, **tables: DataFrame) -> RawTables:
        """A copy in which some tables are replaced, e.g. by a faulty load."""
        return RawTables(self.spark, self.folder, **{**self._tables, **tables})

    def register(self) -> None:
        """Expose the tables to SQL under their declared source names."""
        for name in self.LOADERS:
            getattr(self, name).createOrReplaceTempView(f"raw_{name}")
