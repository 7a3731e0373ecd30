"""Parquet scans with explicit schemas, and the table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input tables. A declared schema saves the footer read of schema inference and
#: turns a drifted file into an error instead of a silently changed type.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table_state(spark: SparkSession, folder: str, name: str) -> tuple[int, int, int] | None:
    """Time of change, bytes and files of a table; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    held = store.getContentSummary(path)
    return store.getFileStatus(path).getModificationTime(), held.getLength(), held.getFileCount()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def write_table(
    df: DataFrame, path: str, partition_by: str | None = None, mode: str = "errorifexists"
) -> DataFrame:
    """Write a table and return it as a fresh scan.

    The rebalance step evens out file sizes; a partition value that holds a large
    share of the rows is split over several tasks instead of filling one.
    """
    if partition_by:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.hint("rebalance").write.mode(mode).parquet(path)
    # The schema is known, so reading back needs no inference job; Spark moves
    # partition columns to the end itself.
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def save_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, path: str, mode: str = "errorifexists"
) -> DataFrame:
    """Save a catalog table bucketed and sorted by a join key.

    Two tables saved with the same key and number of buckets join without a
    shuffle; use it for facts and items when top-product reports run often.
    """
    (
        df.repartition(buckets, key)
        .write.mode(mode)
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def rows_as_json(df: DataFrame, column: str = "row_json") -> DataFrame:
    """One JSON object per row: NULL fields kept, ISO date-times."""
    dates = {f.name for f in df.schema if f.dataType.typeName() == "date"}
    fields = [
        F.col(name).cast("timestamp_ntz").alias(name) if name in dates else F.col(name)
        for name in df.columns
    ]
    options = {
        "ignoreNullFields": "false",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
    }
    return df.select(F.to_json(F.struct(*fields), options).alias(column))
