"""Table profiles, metric history, freshness and ad-hoc reads."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default column and sizes, the search order for bare table names,
# the two patterns that admit a statement, and the error messages.
DEFAULT_COLUMN = "order_id"
HISTORY_DAYS = 14
ROW_CAP = 100
SEARCH_ORDER = ("marts", "staging", "intermediate", "main")
READ_ONLY = r"^\s*(with|select)\b"
NOT_A_QUERY = "Only SELECT/WITH queries are allowed"
FORBIDDEN_WORD = "Forbidden SQL keyword detected"
FORBIDDEN = r"\b(insert|update|delete|drop|create|attach|copy|install)\b"


def null_share(column: str) -> Column:
    return F.avg(F.when(F.col(column).isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))


def table_profile(
    df: DataFrame,
    column: str = DEFAULT_COLUMN,
    day: date | None = None,
    day_column: str = "order_date",
    approximate: bool = False,
) -> DataFrame:
    """Row count, NULL share and distinct count of a column.

    ``approximate`` trades the exact distinct count, which shuffles every value
    once, for a fixed-size sketch without a shuffle by value.
    """
    if day is not None:
        df = df.where(F.col(day_column).cast("date") == F.lit(day))
    distinct = F.approx_count_distinct(column) if approximate else F.countDistinct(column)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        null_share(column).alias("null_rate"),
        distinct.alias("distinct_count"),
    )


def metric_history(
    df: DataFrame,
    metric: str,
    window: int = HISTORY_DAYS,
    daily_sales: DataFrame | None = None,
    day_column: str = "order_date",
) -> DataFrame:
    """Newest ``window`` daily values of a metric.

    ``row_count`` counts the given table per day; ``revenue`` always reads the
    daily mart, whatever table is given; any other name yields the total count.
    """
    if metric == "row_count":
        daily = df.groupBy(F.col(day_column).cast("date").alias("metric_date")).agg(
            F.count(F.lit(1)).alias("metric_value")
        )
    elif metric == "revenue":
        if daily_sales is None:
            raise ValueError("the revenue history reads the daily mart")
        daily = daily_sales.select(
            F.col("order_date").alias("metric_date"), F.col("total_revenue").alias("metric_value")
        )
    else:
        return df.agg(F.count(F.lit(1)).alias("metric_value"))
    return daily.orderBy(F.desc_nulls_last("metric_date")).limit(window)


def freshness(df: DataFrame, ts_column: str = "order_timestamp") -> DataFrame:
    return df.agg(F.max(ts_column).alias("last_seen"))


def describe_table(df: DataFrame) -> DataFrame:
    """Name, type, position and number of values of every column, in one scan."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("column_type"),
            F.col(field.name).alias("value_count"),
        )
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def find_table(spark: SparkSession, name: str, search: tuple[str, ...] = SEARCH_ORDER) -> DataFrame:
    """A table by full name, or by bare name through the layers, marts first.

    Temporary views, which have no database, are the last resort.
    """
    candidates = [name] if "." in name else [*(f"{db}.{name}" for db in search), name]
    for candidate in candidates:
        if spark.catalog.tableExists(candidate):
            return spark.table(candidate)
    raise LookupError(f"Table not found: {name}")


def is_read_only(statement: Column) -> Column:
    """Whether a logged statement only reads."""
    return statement.rlike("(?iU)" + READ_ONLY) & ~statement.rlike("(?iU)" + FORBIDDEN)


def run_read_only(spark: SparkSession, statement: str, limit: int = ROW_CAP) -> DataFrame:
    """Run one reading statement; whatever it says itself, the row cap holds."""
    if not re.match(READ_ONLY, statement, re.IGNORECASE):
        raise ValueError(NOT_A_QUERY)
    if re.search(FORBIDDEN, statement, re.IGNORECASE):
        raise ValueError(FORBIDDEN_WORD)
    return spark.sql(statement.rstrip().rstrip(";")).limit(limit)
