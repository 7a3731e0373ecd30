"""Faulty variants of the raw tables.

The given data is clean, so each check and detector also runs on a load in which
one documented fault was planted. A fault changes rows of the whole table; it
never narrows the table to make a query cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where and how strongly each fault shows.
NULL_CUSTOMER = (997, 3)
DUPLICATE_ORDER = (1250, 1)
BAD_CHANNEL = 1000
ORPHAN_EVERY = 500
ORPHAN_SHIFT = 1_000_000_000
DROP_DAY = "2024-01-17"
NULL_DAYS = ("2024-01-12", "2024-01-14")
REPLAY_DAY = "2024-01-09"
SHIFT_DAYS = ("2024-01-19", "2024-01-21")
MISSING_FROM = ("signup", "2024-01-15")
OUTLIER_DAY = "2024-01-11"
LOAD_STOPPED = "2024-01-22 14:00:00"


def null_customers(orders: DataFrame) -> DataFrame:
    every, rest = NULL_CUSTOMER
    lost = F.col("order_id") % every == rest
    return orders.withColumn("customer_id", F.when(~lost, F.col("customer_id")))


def _repeat(df: DataFrame, repeated: Column) -> DataFrame:
    """Emit the rows that match twice, in the same scan."""
    copies = F.when(repeated, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("copy", F.explode(copies)).drop("copy")


def duplicate_orders(orders: DataFrame) -> DataFrame:
    every, rest = DUPLICATE_ORDER
    return _repeat(orders, F.col("order_id") % every == rest)


def doubled(facts: DataFrame) -> DataFrame:
    """A load that was delivered twice as a whole, read once."""
    return _repeat(facts, F.lit(True))


def bad_channels(orders: DataFrame) -> DataFrame:
    rest = F.col("order_id") % BAD_CHANNEL
    return orders.withColumn(
        "channel", F.when(rest == 0, "marketplace").when(rest != 1, F.col("channel"))
    )


def orphan_products(items: DataFrame) -> DataFrame:
    """Some items point at products that do not exist.

    ``order_item_id`` is order * 10 + line, so order + line is recovered from it.
    """
    line = F.col("order_item_id") - F.col("order_id") * 10
    orphan = (F.col("order_id") + line) % ORPHAN_EVERY == 0
    return items.withColumn(
        "product_id",
        F.when(orphan, F.col("product_id") + ORPHAN_SHIFT).otherwise(F.col("product_id")),
    )


def _day() -> Column:
    return F.col("ts").cast("date")


def volume_drop(events: DataFrame) -> DataFrame:
    return events.where(~((_day() == F.lit(DROP_DAY).cast("date")) & (F.col("event_id") % 10 >= 3)))


def null_spike(events: DataFrame) -> DataFrame:
    hit = _day().between(*[F.lit(d).cast("date") for d in NULL_DAYS]) & (F.col("event_id") % 3 == 0)
    return events.withColumn("user_id", F.when(~hit, F.col("user_id")))


def replayed(events: DataFrame) -> DataFrame:
    """One day in which part of the stream was delivered twice."""
    return _repeat(events, (_day() == F.lit(REPLAY_DAY).cast("date")) & (F.col("event_id") % 12 == 0))


def replayed_everywhere(events: DataFrame) -> DataFrame:
    """Part of every day was delivered twice."""
    return _repeat(events, F.col("event_id") % 12 == 0)


def share_shift(events: DataFrame) -> DataFrame:
    hit = _day().between(*[F.lit(d).cast("date") for d in SHIFT_DAYS]) & (F.col("event_id") % 2 == 0)
    return events.withColumn("event_type", F.when(hit, "click").otherwise(F.col("event_type")))


def missing_dimension(events: DataFrame) -> DataFrame:
    value, start = MISSING_FROM
    return events.where(~((F.col("event_type") == value) & (_day() >= F.lit(start).cast("date"))))


def outliers(events: DataFrame) -> DataFrame:
    hit = (_day() == F.lit(OUTLIER_DAY).cast("date")) & (F.col("event_id") % 10 == 0)
    return events.withColumn("value", F.when(hit, F.col("value") * 1000).otherwise(F.col("value")))


def load_stopped(events: DataFrame) -> DataFrame:
    return events.where(F.col("ts") <= F.lit(LOAD_STOPPED).cast("timestamp_ntz"))


def all_event_faults(events: DataFrame) -> DataFrame:
    """Every planted event fault except the stopped load, in one pass."""
    for fault in (volume_drop, null_spike, replayed, share_shift, missing_dimension, outliers):
        events = fault(events)
    return events
