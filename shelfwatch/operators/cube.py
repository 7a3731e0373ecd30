"""A stored cube of daily counts that the detectors read instead of the table.

One grouping by (day, value of a dimension) gives counts, nulls, cents, extremes and rows above a limit. All
of them merge by adding or comparing, so a load is reduced on its own, written as a partition of its own, and
never reads the table or other loads again. A repeated load replaces its partition, hence a job that was cut
off is simply run again. Readers merge the loads; a day's total is the sum over its values.

Rows without a time or a value form a group of their own, as they do where detectors read the table. Empty
loads write an empty partition.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.functions.money import cents, from_cents
from shelfwatch.operators import anomalies

CELL = (
    "day date, value string, row_count bigint, null_count bigint, cents bigint, amounts bigint, "
    "low double, high double, above bigint, last_seen timestamp_ntz"
)


def cells(
    df: DataFrame, ts: str, dimension: str, tested: str, amount: str, limit: float
) -> DataFrame:
    """Counts per (day, value); ``tested`` is the column whose nulls count, ``limit`` the one for outliers."""
    return df.groupBy(F.col(ts).cast("date").alias("day"), F.col(dimension).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(tested).isNull()).alias("null_count"),
        F.sum(cents(amount)).alias("cents"),
        F.count(amount).alias("amounts"),
        F.min(amount).cast("double").alias("low"),
        F.max(amount).cast("double").alias("high"),
        F.count_if(F.col(amount) > limit).alias("above"),
        F.max(F.col(ts).cast("timestamp_ntz")).alias("last_seen"),
    )


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Cells of several loads, or of several values, added up per ``by``."""
    sums = [F.sum(c).alias(c) for c in ("row_count", "null_count", "cents", "amounts", "above")]
    ends = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("last_seen").alias("last_seen")]
    return parts.groupBy(*by).agg(*sums, *ends)


class DailyCube:
    """Cells stored below ``path``, one partition per load."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, load: str, part: DataFrame) -> None:
        """Store the cells of a load; a load of that name is replaced, all others stay as they are."""
        if not re.fullmatch(r"[\w.-]+", load):
            raise ValueError("a load is named by letters, digits, dots, dashes and underscores")
        names = [field.split()[0] for field in CELL.split(", ")]
        part.select(*names).write.mode("overwrite").parquet(f"{self.path}/load={load}")

    def read(self) -> DataFrame:
        """One row per (day, value) over all loads."""
        stored = self.spark.read.schema(f"{CELL}, load string").parquet(self.path)
        return merged(stored, "day", "value")

    def days(self) -> DataFrame:
        """One row per day over all loads and values."""
        return merged(self.read(), "day")

    # -- detectors ---------------------------------------------------------

    def volume_drop(self, days: int = 7, factor: float = 0.5) -> DataFrame:
        return anomalies.volume_drop_days(self.days().select("day", "row_count"), days, factor)

    def freshness_gap(self, as_of: Column) -> DataFrame:
        return anomalies.freshness_gap_days(
            self.days().select("day", F.col("last_seen").alias("day_last")), as_of
        )

    def null_rate_spike(self, threshold: float = 0.2) -> DataFrame:
        rate = F.round(F.col("null_count") / F.col("row_count"), 6).alias("null_rate")
        return self.days().select("day", "row_count", rate).where(F.col("null_rate") > threshold)

    def distribution_shift(self, threshold: float = 0.2) -> DataFrame:
        counts = self.read().select("day", "value", "row_count")
        return anomalies.distribution_shift_days(counts, counts.agg(F.sum("row_count")).scalar(), threshold)

    def kpi_drop(self, factor: float = 0.5) -> DataFrame:
        return anomalies.kpi_drop(self.days().select("day", from_cents(F.col("cents")).alias("revenue")), factor)

    def dimension_missing(self) -> DataFrame:
        seen = self.read().select("day", "value")
        return anomalies.dimension_missing_days(seen, seen.agg(F.max("day")).scalar())

    def outlier_days(self) -> DataFrame:
        """Days with amounts above the limit, their number and the largest."""
        return self.days().where("above > 0").select("day", "above", "high")

    def profile(self) -> DataFrame:
        """Rows, null share, revenue and extremes of each day, with the change of rows to the day before."""
        before = F.lag("row_count").over(Window.orderBy("day"))
        return self.days().select(
            "day",
            "row_count",
            F.round(F.col("null_count") / F.col("row_count"), 6).alias("null_rate"),
            from_cents(F.col("cents")).alias("revenue"),
            F.col("low").alias("least"),
            F.col("high").alias("most"),
            (F.col("row_count") - before).alias("row_change"),
        )
