"""Ten anomaly detectors and their scorer.

Each detector reduces the table to daily rows with map-side aggregation first.
Windows without a partition key run over those daily rows only, whose number is
bounded by the calendar. Thresholds are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.functions.money import money_sum
from shelfwatch.functions.skew import split_join, union_all
from shelfwatch.operators.profile import null_share

# The labelled anomaly types.
ANOMALY_TYPES = (
    "volume_drop",
    "freshness_gap",
    "null_rate_spike",
    "duplicates",
    "distribution_shift",
    "kpi_drop",
    "dimension_missing",
    "outliers",
    "referential_integrity",
    "dbt_transformation_error",
)


def _day(ts: str) -> Column:
    return F.col(ts).cast("date").alias("day")


def volume_drop(df: DataFrame, ts: str = "ts", days: int = 7, factor: float = 0.5) -> DataFrame:
    """Days with far fewer rows than the average of the preceding days."""
    return volume_drop_days(df.groupBy(_day(ts)).agg(F.count(F.lit(1)).alias("row_count")), days, factor)


def volume_drop_days(daily: DataFrame, days: int = 7, factor: float = 0.5) -> DataFrame:
    """The same from one row per day."""
    before = Window.orderBy("day").rowsBetween(-days, -1)
    return (
        daily.withColumn("rolling_avg", F.avg("row_count").over(before))
        .where(F.col("row_count") < F.col("rolling_avg") * factor)
        .select("day", "row_count", F.round("rolling_avg", 6).alias("rolling_avg"))
    )


def freshness_gap(df: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Days up to ``as_of`` without any row, with the last row seen overall."""
    return freshness_gap_days(df.groupBy(_day(ts)).agg(F.max(ts).alias("day_last")), as_of)


def freshness_gap_days(seen: DataFrame, as_of: Column) -> DataFrame:
    """The same from one row per day with rows."""
    span = seen.agg(F.min("day").alias("first_day"), F.max("day_last").alias("last_seen"))
    calendar = span.select("last_seen", F.explode(F.sequence("first_day", as_of)).alias("day"))
    return calendar.join(seen.select("day"), "day", "left_anti").select(
        "day", "last_seen", F.date_diff("day", F.col("last_seen").cast("date")).alias("days_late")
    )


def null_rate_spike(df: DataFrame, column: str, ts: str = "ts", threshold: float = 0.2) -> DataFrame:
    """Days on which too many rows lack a value."""
    daily = df.groupBy(_day(ts)).agg(
        F.count(F.lit(1)).alias("row_count"), F.round(null_share(column), 6).alias("null_rate")
    )
    return daily.where(F.col("null_rate") > threshold)


def duplicates(df: DataFrame, key: str, ts: str = "ts", threshold: float = 0.05) -> DataFrame:
    """Days on which too many rows repeat a key."""
    daily = df.groupBy(_day(ts)).agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct(key).alias("distinct_keys")
    )
    rate = F.round(1 - F.col("distinct_keys") / F.col("row_count"), 6)
    return daily.withColumn("duplicate_rate", rate).where(F.col("duplicate_rate") > threshold)


def distribution_shift(
    df: DataFrame, dimension: str, ts: str = "ts", threshold: float = 0.2
) -> DataFrame:
    """Days on which a value's share exceeds its overall share by far."""
    counts = df.groupBy(_day(ts), F.col(dimension).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    # The grand total is a column-free count of the table, so no window over
    # all (day, value) rows is needed.
    return distribution_shift_days(counts, df.agg(F.count(F.lit(1))).scalar(), threshold)


def distribution_shift_days(counts: DataFrame, total: Column, threshold: float = 0.2) -> DataFrame:
    """The same from one row per (day, value)."""
    day_total = F.sum("row_count").over(Window.partitionBy("day"))
    value_total = F.sum("row_count").over(Window.partitionBy("value"))
    shares = counts.select(
        "day",
        "value",
        F.round(F.col("row_count") / day_total, 6).alias("share"),
        F.round(value_total / total, 6).alias("baseline_share"),
    )
    return shares.where(F.col("share") - F.col("baseline_share") > threshold)


def daily_revenue(df: DataFrame, amount: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(_day(ts)).agg(money_sum(amount).alias("revenue"))


def kpi_drop(daily: DataFrame, factor: float = 0.5) -> DataFrame:
    """Days whose revenue is below a share of the same weekday last week."""
    week_ago = Window.orderBy(F.unix_date("day")).rangeBetween(-7, -7)
    return daily.withColumn("revenue_week_ago", F.max("revenue").over(week_ago)).where(
        F.col("revenue") < F.col("revenue_week_ago") * factor
    )


def dimension_missing(df: DataFrame, dimension: str, ts: str = "ts") -> DataFrame:
    """Days on which a value that had been seen before does not occur.

    Each known value spans its own days from first sight to the last loaded day,
    so the number of rows is values times calendar days.
    """
    seen = df.select(_day(ts), F.col(dimension).alias("value")).distinct()
    return dimension_missing_days(seen, df.agg(F.max(F.col(ts).cast("date"))).scalar())


def dimension_missing_days(seen: DataFrame, last_day: Column) -> DataFrame:
    """The same from one row per (day, value)."""
    expected = (
        seen.where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.min("day").alias("first_day"))
        .select("value", F.explode(F.sequence("first_day", last_day)).alias("day"))
    )
    return expected.join(seen, ["day", "value"], "left_anti").select("day", "value")


def outliers(df: DataFrame, amount: str, limit: float, show: Sequence[str]) -> DataFrame:
    """Rows whose amount is above the limit."""
    return df.where(F.col(amount) > limit).select(*show)


def orphan_rate(
    items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    threshold: float = 0.05,
    hot_products: Sequence[Any] = (),
    hot_orders: Sequence[Any] = (),
) -> DataFrame:
    """Days on which too many items reference a missing product.

    Items are flagged, then summed per order, and only then meet the orders.
    """
    known = products.select("product_id").distinct().withColumn("known", F.lit(True))
    flagged = union_all(
        split_join(items.select("order_id", "product_id"), known, "product_id", "left", hot_products)
    )
    per_order = flagged.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("known").isNull()).alias("orphans")
    )
    dated = union_all(
        split_join(orders.select("order_id", "order_date"), per_order, "order_id", "inner", hot_orders)
    )
    daily = dated.groupBy(F.col("order_date").alias("day")).agg(
        F.sum("items").alias("item_count"), F.sum("orphans").alias("orphan_count")
    )
    rate = F.round(F.col("orphan_count") / F.col("item_count"), 6)
    return daily.withColumn("orphan_rate", rate).where(F.col("orphan_rate") > threshold)


def missing_status(
    orders: DataFrame,
    items: DataFrame,
    facts: DataFrame,
    accepted: Sequence[str],
    hot_orders: Sequence[Any] = (),
) -> DataFrame:
    """Accepted orders with items that did not reach the facts, by day and status.

    Orders without items never become facts, so they are set aside first. Both
    tests use the order id and share one partitioning.
    """
    kept = orders.where(F.col("order_status").isin(*accepted)).select("order_id", "order_date", "order_status")
    with_items = items.select("order_id").distinct()
    loaded = facts.select("order_id").distinct()
    due = split_join(kept, with_items, "order_id", "left_semi", hot_orders)
    if len(due) == 1:
        lost = due[0].join(loaded, "order_id", "left_anti")
    else:
        lost = union_all(
            [
                due[0].join(loaded, "order_id", "left_anti"),
                due[1].join(
                    F.broadcast(loaded.where(F.col("order_id").isin([k for k in hot_orders if k is not None]))),
                    "order_id",
                    "left_anti",
                ),
            ]
        )
    return lost.groupBy("order_date", "order_status").agg(F.count(F.lit(1)).alias("missing_orders"))


def detected_types(findings: Mapping[str, DataFrame]) -> DataFrame:
    """Names of the detectors that found something, with the number of findings."""
    return union_all(
        [
            rows.agg(F.count(F.lit(1)).alias("findings"))
            .where(F.col("findings") > 0)
            .select(F.lit(name).alias("anomaly_type"), "findings")
            for name, rows in findings.items()
        ]
    )


def detection_scores(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 over the two sets of types; 0 where undefined."""
    found = detected.select("anomaly_type").distinct().withColumn("found", F.lit(True))
    labelled = truth.select("anomaly_type").distinct().withColumn("labelled", F.lit(True))
    found_one, true_one = F.col("found").isNotNull(), F.col("labelled").isNotNull()
    counts = found.join(labelled, "anomaly_type", "full").agg(
        F.count_if(found_one & true_one).alias("tp"),
        F.count_if(found_one & ~true_one).alias("fp"),
        F.count_if(~found_one & true_one).alias("fn"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * precision * recall, precision + recall))
        .select("precision", "recall", "f1", "tp", "fp", "fn")
    )
