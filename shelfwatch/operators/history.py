"""Customer versions over time, the temporal join and the incremental fact."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.functions.skew import split_join, union_all
from shelfwatch.operators.checks import unique
from shelfwatch.plans.models import FACT_COLUMNS, read_facts, write_facts

class DuplicateMergeKeys(RuntimeError):
    """The incremental source would hit a merge key more than once."""


# The version history and the message of the guard.
OPEN_END = "9999-12-31"
VERSION_SHIFT_DAYS = 180
DUPLICATES_MESSAGE = (
    "MERGE failed on fct_orders: duplicate key order_id detected in the incremental source "
    "({count} recent orders are multiplied by overlapping dim_customers SCD2 versions)."
)

VERSION_COLUMNS = (
    "customer_id",
    "first_name",
    "last_name",
    "email",
    "customer_type",
    "country_code",
    "valid_from",
    "valid_to",
    "is_current",
)


def customer_versions(customers: DataFrame, orders: DataFrame, recent_start: date) -> DataFrame:
    """One open version per customer, and a second for those with recent orders.

    The second version starts 180 days after sign-up and the first is never
    closed, so the two overlap: the defect that the guard below must find.
    """
    recent = (
        orders.where(F.col("order_date") >= F.lit(recent_start)).select("customer_id").distinct()
    )

    def version(rows: DataFrame, valid_from) -> DataFrame:
        return rows.select(
            *VERSION_COLUMNS[:6],
            valid_from.alias("valid_from"),
            F.lit(OPEN_END).cast("date").alias("valid_to"),
            F.lit(True).alias("is_current"),
        )

    stable = version(customers, F.col("signup_date"))
    shifted = version(
        customers.join(recent, "customer_id", "left_semi"),
        F.date_add("signup_date", VERSION_SHIFT_DAYS),
    )
    return stable.unionByName(shifted)


def _next_start() -> Window:
    # At most one row per customer and calendar day reaches this window, so its
    # partitions are bounded by the calendar even if a customer is hot.
    return F.lead("valid_from").over(Window.partitionBy("customer_id").orderBy("valid_from"))


def overlapping_versions(versions: DataFrame) -> DataFrame:
    """Version starts whose validity reaches the next version of the customer.

    Versions with the same start are merged first (map-side) and reported as an
    overlap themselves.
    """
    starts = versions.groupBy("customer_id", "valid_from").agg(
        F.max("valid_to").alias("valid_to"), F.count(F.lit(1)).alias("version_count")
    )
    with_next = starts.withColumn("next_valid_from", _next_start())
    overlaps = (F.col("version_count") > 1) | (F.col("next_valid_from") <= F.col("valid_to"))
    return with_next.where(overlaps)


def close_versions(versions: DataFrame) -> DataFrame:
    """Repaired history: every version ends the day before the next one starts.

    Of several versions with one start, the one that sorts last by its
    attributes is kept.
    """
    attributes = [c for c in VERSION_COLUMNS if c not in ("customer_id", "valid_from", "is_current")]
    pick = Window.partitionBy("customer_id", "valid_from").orderBy(
        *[F.desc_nulls_last(c) for c in attributes]
    )
    # rank = 1 is pruned on the map side (WindowGroupLimit) before the shuffle.
    single = versions.withColumn("pick", F.row_number().over(pick)).where("pick = 1").drop("pick")
    next_start = _next_start()
    return (
        single.withColumn("next_valid_from", next_start)
        .withColumn(
            "valid_to",
            F.when(F.col("next_valid_from") <= F.col("valid_to"), F.date_sub("next_valid_from", 1)).otherwise(
                F.col("valid_to")
            ),
        )
        .withColumn("is_current", F.col("next_valid_from").isNull())
        .select(*VERSION_COLUMNS)
    )


def temporal_join(orders: DataFrame, versions: DataFrame) -> DataFrame:
    """Orders with every customer version valid on the order date.

    The customer is the equi key and the interval a residual condition. Both
    sides are plain shuffles, so adaptive execution splits a hot customer.
    """
    v = versions.withColumnRenamed("customer_id", "version_customer_id")
    valid = (
        (F.col("customer_id") == F.col("version_customer_id"))
        & (F.col("order_date") >= F.col("valid_from"))
        & (F.col("order_date") <= F.col("valid_to"))
    )
    return orders.join(v, valid, "left").drop("version_customer_id")


def orders_with_versions(revenue: DataFrame, versions: DataFrame) -> DataFrame:
    return temporal_join(
        revenue.select(*FACT_COLUMNS), versions.select("customer_id", "valid_from", "valid_to")
    )


def latest_version_only(joined: DataFrame) -> DataFrame:
    """One row per order: the one with the latest customer version.

    Copies of an order compete as well; the remaining columns break ties. Rank 1
    is pruned map-side, so a much-copied order reaches the shuffle once per task.
    """
    tie_break = [c for c in FACT_COLUMNS if c != "order_id"]
    latest = Window.partitionBy("order_id").orderBy(
        F.desc_nulls_last("valid_from"), *[F.desc_nulls_last(c) for c in tie_break]
    )
    return (
        joined.withColumn("customer_version_rank", F.row_number().over(latest))
        .where(F.col("customer_version_rank") == 1)
        .select(*FACT_COLUMNS)
    )


def multiplied_orders(revenue: DataFrame, versions: DataFrame, recent_start: date) -> DataFrame:
    """Recent orders that match more than one customer version."""
    recent = revenue.where(F.col("order_date") >= F.lit(recent_start))
    joined = temporal_join(
        recent.select("order_id", "customer_id", "order_date"),
        versions.select("customer_id", "valid_from", "valid_to"),
    )
    return unique(joined, ["order_id"])


def merge_duplicate_guard(revenue: DataFrame, versions: DataFrame, recent_start: date) -> DataFrame:
    """Number of recent orders that overlapping versions would multiply."""
    return multiplied_orders(revenue, versions, recent_start).agg(
        F.count(F.lit(1)).alias("duplicate_order_count")
    )


def require_single_versions(revenue: DataFrame, versions: DataFrame, recent_start: date) -> None:
    """Stop before a merge whose source has duplicate keys."""
    count = merge_duplicate_guard(revenue, versions, recent_start).first()[0]
    if count > 0:
        raise DuplicateMergeKeys(DUPLICATES_MESSAGE.format(count=count))


def full_refresh(revenue: DataFrame, versions: DataFrame) -> DataFrame:
    """Rebuild the facts from all orders, one row per order."""
    return latest_version_only(orders_with_versions(revenue, versions))


def incremental_source(
    revenue: DataFrame, versions: DataFrame, recent_start: date, repair: bool = False
) -> DataFrame:
    """Recent facts to merge.

    Without ``repair`` the rank is not applied: overlapping versions would
    multiply orders, and only the guard prevents it. ``repair`` picks one version
    per order here as the full refresh does.
    """
    recent = revenue.where(F.col("order_date") >= F.lit(recent_start))
    joined = orders_with_versions(recent, versions)
    return latest_version_only(joined) if repair else joined.select(*FACT_COLUMNS)


def upsert(
    target: DataFrame, source: DataFrame, key: str = "order_id", hot: Sequence[Any] = ()
) -> DataFrame:
    """Rows of ``source``, plus the rows of ``target`` that it does not replace.

    Matching is by key alone, so an order whose date moved leaves its old place.
    The result is meant for a new snapshot folder, never for the one being read.
    ``hot`` names keys that hold a large share of the target rows.
    """
    replaced = source.select(key).distinct()
    kept = union_all(split_join(target, replaced, key, "left_anti", hot))
    return kept.select(*source.columns).unionByName(source)


def incremental_merge(
    target: DataFrame,
    revenue: DataFrame,
    versions: DataFrame,
    recent_start: date,
    repair: bool = False,
    hot: Sequence[Any] = (),
) -> DataFrame:
    """Guard, then merge the recent orders into the previous facts."""
    if not repair:
        require_single_versions(revenue, versions, recent_start)
    source = incremental_source(revenue, versions, recent_start, repair)
    return upsert(target.select(*FACT_COLUMNS), source, hot=hot)


def merge_snapshot(
    previous_path: str,
    new_path: str,
    revenue: DataFrame,
    versions: DataFrame,
    recent_start: date,
    repair: bool = False,
    hot: Sequence[Any] = (),
) -> DataFrame:
    """Merge into the facts stored at one path and store the result at another.

    Readers keep the previous snapshot until they are pointed at the new one.
    """
    previous = read_facts(revenue.sparkSession, previous_path)
    merged = incremental_merge(previous, revenue, versions, recent_start, repair, hot)
    return write_facts(merged, new_path)


class FactStore:
    """Order facts as a catalog table: a folder per month, in it files bucketed by order.

    A merge reads the stored source and the months it touches, joins them bucket by bucket without a
    shuffle, and replaces the files of those months only. Doing it again, after a lost driver too, gives the same facts.
    """

    COLUMNS = (*FACT_COLUMNS, "order_month")

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int | None = None) -> None:
        self.spark, self.table, self.path = spark, table, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _by_month(self, facts: DataFrame) -> DataFrame:
        return facts.select(*FACT_COLUMNS, F.trunc("order_date", "MM").alias("order_month"))

    def create(self, facts: DataFrame) -> FactStore:
        rows = self._by_month(facts).repartition(self.buckets, "order_id")
        writer = rows.write.partitionBy("order_month").bucketBy(self.buckets, "order_id").option("path", self.path)
        writer.saveAsTable(self.table)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def forget(self, *staged: str) -> DataFrame:
        """Drop the names from the catalog, keep the files, and return the facts as a plain scan."""
        for name in (self.table, *staged):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return read_facts(self.spark, self.path).select(*FACT_COLUMNS)

    def stage(self, source: DataFrame, table: str) -> DataFrame:
        """Store the rows to merge, bucketed as the facts are: whatever they are made from is read once."""
        rows = self._by_month(source).repartition(self.buckets, "order_id")
        rows.write.bucketBy(self.buckets, "order_id").option("path", f"{self.path}.{table}").saveAsTable(table)
        return self.spark.table(table)

    def months(self, staged: DataFrame) -> DataFrame:
        """(order_month, incoming, replaced, kept) per month: rows of the source, and of the facts with and without an order in it."""
        keys = staged.select("order_id").distinct().withColumn("is_replaced", F.lit(True))
        found = self.read().select("order_id", "order_month").join(keys, "order_id", "left")
        is_replaced, zero = F.col("is_replaced").isNotNull(), F.lit(0).cast("long")
        stored = found.groupBy("order_month").agg(zero.alias("incoming"), F.count_if(is_replaced).alias("replaced"), F.count_if(~is_replaced).alias("kept"))
        new = staged.groupBy("order_month").agg(F.count(F.lit(1)).alias("incoming"), zero.alias("replaced"), zero.alias("kept"))
        every = stored.unionByName(new).groupBy("order_month")
        return every.agg(*[F.sum(c).alias(c) for c in ("incoming", "replaced", "kept")]).where("incoming > 0 or replaced > 0")

    def merge(self, staged: DataFrame) -> list[date | None]:
        """Replace the orders of ``staged`` in the facts; returns the months whose files changed."""
        touched = {r["order_month"]: r for r in self.months(staged).collect()}  # a row per month of the calendar
        if not touched:
            return []
        days = [m for m in touched if m is not None]
        here = F.col("order_month").isin(days) if days else F.lit(False)
        if None in touched:
            here = here | F.col("order_month").isNull()
        kept = self.read().where(here).join(staged.select("order_id"), "order_id", "left_anti")
        rows = kept.select(*self.COLUMNS).unionByName(staged.select(*self.COLUMNS)).repartition(self.buckets, "order_id")
        # Complete beside the facts before a month is replaced: facts cannot be read and overwritten at once.
        pending = f"{self.table}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "order_id").option("path", f"{self.path}.{pending}").saveAsTable(pending)
        ready = self.spark.table(pending).select(self.read().columns)
        # A catalog table takes this from the session; without it, all other months would go.
        setting = "spark.sql.sources.partitionOverwriteMode"
        usual = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "dynamic")
        try:
            ready.write.mode("overwrite").insertInto(self.table)
        finally:
            self.spark.conf.set(setting, usual)
        self.spark.sql(f"DROP TABLE {pending}")
        # A month whose last order moved elsewhere brings no rows that could replace its folder.
        for month, r in touched.items():
            if not r["incoming"] and not r["kept"]:
                name = "__HIVE_DEFAULT_PARTITION__" if month is None else month.isoformat()
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/order_month={name}")
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.spark.catalog.refreshTable(self.table)
        return sorted(touched, key=str)


def stored_merge(
    store: FactStore,
    revenue: DataFrame,
    versions: DataFrame,
    recent_start: date,
    staging: str,
    repair: bool = False,
) -> list[date | None]:
    """Guard, then merge the recent orders into stored facts; returns the months that changed.

    The guard looks at the staged rows, so the revenue and the versions are read once.
    """
    staged = store.stage(incremental_source(revenue, versions, recent_start, repair), staging)
    if not repair:
        count = unique(staged, ["order_id"]).count()
        if count > 0:
            raise DuplicateMergeKeys(DUPLICATES_MESSAGE.format(count=count))
    return store.merge(staged)


def merge_into_table(spark: SparkSession, table: str, source: DataFrame, key: str = "order_id") -> None:
    """The same merge in place, for catalogs whose tables support MERGE."""
    target = spark.table(table)
    (
        source.mergeInto(table, target[key] == source[key])
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )
