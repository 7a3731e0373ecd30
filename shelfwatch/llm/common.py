"""Helpers that several operators share: row tables, written intermediates, let-bindings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.session import scratch_path

#: White space of every word rule here: space, tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
#: Words kept by one worker's memo before it starts anew; bounds its memory, changes no result.
MEMO_WORDS = 400_000
#: Bits of a filter that spares rows a shuffle (8 MB).
FILTER_BITS = 1 << 26
#: Bits of the largest one (64 MB).
MOST_FILTER_BITS = 1 << 29


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_names(df: DataFrame, count: int) -> list[str]:
    """Names for helper columns that ``df`` does not have, whatever its columns are called."""
    taken, found, number = {c.lower() for c in df.columns}, [], 0
    while len(found) < count:
        if (name := f"helper_{number}") not in taken:
            found.append(name)
        number += 1
    return found


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each gets about ``rows_each`` rows, at least the session's number."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(rows / rows_each))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def batches(source: Iterable[pa.RecordBatch], bytes_each: int = 8_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a step holds about ``bytes_each`` of ``column`` at once.

    A single longer text makes a batch of its own; nothing is shortened.
    """
    for batch in source:
        sizes = batch.column(column).nbytes / max(1, batch.num_rows)
        step = max(1, int(bytes_each / max(1.0, sizes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows that actions inside this block hand to Python at once, at most: bounds the buffers of long texts on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions inside this block delete their shuffle files when they end, not when the driver collects its garbage.

    Only for frames that are consumed once: a second action on the same one would not find its shuffles.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class WordHashes:
    """64-bit hashes of words, remembered per worker up to ``MEMO_WORDS`` words."""

    def __init__(self, seed: int = 0) -> None:
        self.seed, self.memo = seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo, seed, hashed = self.memo, self.seed, xxhash.xxh3_64_digest
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found = list(map(memo.get, words))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = memo.setdefault(words[i], hashed(words[i], seed))
        return np.frombuffer(b"".join(found), "<u8")


def dense(cells: DataFrame, size: int) -> np.ndarray:
    """An array of ``size`` longs from rows (cell, value): sent to the driver as packed chunks, not as rows."""
    chunk = 4096

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(chunk, np.int64)
        values[part["cell"].to_numpy() % chunk] = part["value"].to_numpy()
        return pd.DataFrame({"chunk": [key[0]], "data": [values.tobytes()]})

    grouped = cells.withColumn("chunk", F.floor(F.col("cell") / chunk).cast("int")).groupBy("chunk")
    table = np.zeros(-(-size // chunk) * chunk, np.int64)
    for row in grouped.applyInPandas(pack, "chunk int, data binary").collect():
        table[row["chunk"] * chunk :][:chunk] = np.frombuffer(row["data"], np.int64)
    return table[:size]


def maybe_in(rows: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose long ``column`` may be among ``keys`` (one column of that name): none is missed."""
    return rows.where(may_be(keys, column, bits)(column))


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> Broadcast:
    """One bit per key at ``key mod bits``, shared with all tasks; see ``may_be``."""
    bit = F.pmod(column, F.lit(bits))
    words = keys.select((bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("bit"))
    filled = words.groupBy(F.col("word").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, bit)) AS value"))
    return keys.sparkSession.sparkContext.broadcast(dense(filled, bits // 64))


def filter_bits(keys: int) -> int:
    """Bits of a filter of so many keys: 32 for each at least, within bounds."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (32 * keys).bit_length()))


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the long ``keys`` have their bit in the words of a ``bit_filter``."""
    at = keys % (64 * len(table))
    return (table[at // 64] >> (at % 64)) & 1 == 1


def may_be(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> Callable[[str], Column]:
    """A test of a long column for being perhaps among ``keys``.

    A one-hash bit filter. Only its words travel (``bits / 8`` bytes at most), so its size is
    bounded whatever the number of keys; a fuller filter lets more other rows through.
    """
    return bit_test(bit_filter(keys, column, bits))


def bit_test(shared: Broadcast) -> Callable[[str], Column]:
    """``may_be`` of a ``bit_filter``."""

    @F.pandas_udf("boolean")
    def maybe(value: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, value.to_numpy(np.int64)))

    return maybe
