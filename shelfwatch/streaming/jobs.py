"""Structured Streaming jobs over the event table.

All state is keyed and bounded by a watermark, sinks are tables in the shared
folder, and every job can be restarted from its own checkpoint.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent

from shelfwatch.session import scratch_path
from shelfwatch.sources.tables import SCHEMAS

#: How late a replayed event may arrive and still be recognised.
REPLAY_DELAY = "40 days"
#: How late an event may arrive and still count for its day.
LATE_EVENTS = "2 days"


def utc_instant(wall_clock: Column) -> Column:
    """Zoned timestamp of a UTC wall-clock time, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock).cast("timestamp")


def utc_wall_clock(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def read_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream, with ``ts`` as the zoned timestamp that watermarks need.

    ``events.parquet`` may be a folder of part files; otherwise files named ``events*.parquet`` are read.
    """
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path) and store.getFileStatus(path).isDirectory():
        events = reader.parquet(path.toString())
    else:
        events = reader.option("pathGlobFilter", "events*.parquet").parquet(folder)
    return events.withColumn("ts", utc_instant(F.col("ts")))


def _drop_copies(key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates(key)

    return combine


def dedup_stream(
    events: DataFrame, key: str = "event_id", delay: str = REPLAY_DELAY, combine_first: bool = False
) -> DataFrame:
    """First delivery of every event; a key is forgotten after the delay.

    The stateful operator shuffles every delivery by key. ``combine_first`` drops
    copies inside each Arrow batch before that shuffle; switch it on when a few
    events are delivered so often that one state partition becomes the bottleneck.
    """
    if combine_first:
        events = events.mapInPandas(_drop_copies(key), events.schema)
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def dedup_batch(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Batch twin of :func:`dedup_stream`."""
    return events.dropDuplicates([key])


def daily_volume(events: DataFrame, delay: str = LATE_EVENTS) -> DataFrame:
    """Number of events and last event per day."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("day_window"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.max("ts").alias("last_seen"))
        .select(
            utc_wall_clock(F.col("day_window.start")).cast("date").alias("day"),
            "event_count",
            utc_wall_clock(F.col("last_seen")).alias("last_seen"),
        )
    )


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows as files; the file sink is exactly-once per batch."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all batch folders below ``root`` with their batch; none where no batch was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").parquet(root)


class DailyCounts:
    """Daily volume as a table of counts, one folder per batch, that its readers add up.

    The table keeps the stream's watermark itself: before a batch it is the latest event of all
    earlier batches minus ``delay``, so a restarted or repeated batch meets the same one. Days that end
    before it are finished. Events of finished days are late; they are counted on rows of their own, so the total
    is the same however events are cut into batches, and :meth:`late` tells what came after a day was reported.
    A batch costs what it brings, and reads one row per day and batch.
    """

    SCHEMA = "day date, is_late boolean, event_count bigint, last_seen timestamp_ntz"

    def __init__(self, root: str, delay: str = LATE_EVENTS) -> None:
        self.root, self.delay = root, delay

    def _counts(self, spark: SparkSession) -> DataFrame:
        return read_batches(spark, self.root, self.SCHEMA)

    def watermark(self, spark: SparkSession, before_batch: int | None = None) -> DataFrame:
        """One row: the time that events of the stream have passed, NULL before the first event."""
        counts = self._counts(spark)
        counts = counts if before_batch is None else counts.where(F.col("batch") < before_batch)
        return counts.agg((F.max("last_seen") - F.expr(f"INTERVAL {self.delay}")).alias("watermark"))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        seen = utc_wall_clock(F.col("ts"))
        # Rows of a batch that runs again must not count as earlier ones, so its own folder is left out.
        passed = self.watermark(batch.sparkSession, batch_id).first()["watermark"]
        day = seen.cast("date")
        is_late = F.coalesce(F.date_add(day, 1).cast("timestamp_ntz") <= F.lit(passed), F.lit(False)) if passed else F.lit(False)
        counts = batch.groupBy(day.alias("day"), is_late.alias("is_late")).agg(
            F.count(F.lit(1)).alias("event_count"), F.max(seen).alias("last_seen")
        )
        counts.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def total(self, spark: SparkSession) -> DataFrame:
        """Events and last event of every day seen so far, late ones included."""
        return self._counts(spark).groupBy("day").agg(
            F.sum("event_count").alias("event_count"), F.max("last_seen").alias("last_seen")
        )

    def finished(self, spark: SparkSession) -> DataFrame:
        """Days that the watermark has passed, as first reported and with what came late."""
        on_time, late = F.when(~F.col("is_late"), F.col("event_count")), F.when(F.col("is_late"), F.col("event_count"))
        days = self._counts(spark).groupBy("day").agg(
            F.coalesce(F.sum(on_time), F.lit(0)).alias("event_count"), F.coalesce(F.sum(late), F.lit(0)).alias("late_count")
        )
        over = F.date_add("day", 1).cast("timestamp_ntz") <= F.col("watermark")
        return days.join(F.broadcast(self.watermark(spark)), over).select("day", "event_count", "late_count")

    def late(self, spark: SparkSession) -> DataFrame:
        """(day, batch, event_count, last_seen) of events that came after their day was finished."""
        return self._counts(spark).where("is_late").select("day", "batch", "event_count", "last_seen")


class KeyedUpserts:
    """Upsert micro-batches into a table of changes, one folder per batch.

    A batch writes only its own rows, one per key, into the folder named by its
    id, so its cost does not grow with the table and a repeated batch replaces
    itself. :meth:`latest` reads the newest row of every key; :meth:`compact`
    starts a new table from it when the changes have piled up.
    ``newest_first`` decides which row of a key wins, in one batch and between batches,
    so the result does not depend on how rows are cut into batches.
    """

    def __init__(
        self, root: str, schema: str, key: str, newest_first: Callable[[], Sequence] | None = None
    ) -> None:
        self.root, self.schema, self.key = root, schema, key
        self.newest_first = newest_first

    def _first_per_key(self, rows: DataFrame, *order: Column) -> DataFrame:
        # Rank 1 is pruned map-side, so a hot key reaches the shuffle once per task.
        pick = Window.partitionBy(self.key).orderBy(*order)
        return rows.withColumn("pick", F.row_number().over(pick)).where("pick = 1").drop("pick")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        rows = self._first_per_key(batch, *self.newest_first()) if self.newest_first else batch
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def latest(self, spark: SparkSession) -> DataFrame:
        """The winning row of every key over all batches: ``newest_first``, then the later batch."""
        order = self.newest_first() if self.newest_first else ()
        return self._first_per_key(read_batches(spark, self.root, self.schema), *order, F.desc("batch")).drop("batch")

    def compact(self, spark: SparkSession, root: str) -> KeyedUpserts:
        """Copy the newest rows into a new table, as its batch -1."""
        self.latest(spark).write.parquet(f"{root}/batch=-1")
        return KeyedUpserts(root, self.schema, self.key, self.newest_first)

    def start(self, stream: DataFrame, checkpoint: str, mode: str = "append") -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.merge)
            .option("checkpointLocation", checkpoint)
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )

    def run(self, stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
        """Process all available input and return the newest rows."""
        self.start(stream, checkpoint, mode).awaitTermination()
        return self.latest(stream.sparkSession)


class DroppedRows(StreamingQueryListener):
    """Rows that one query dropped as too late, over all its batches; a query itself remembers the last hundred only."""

    def __init__(self) -> None:
        self.by_batch: dict[int, int] = {}
        self.over = threading.Event()

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        batch = event.progress
        # A batch that is reported twice counts once.
        self.by_batch[batch.batchId] = sum(state.numRowsDroppedByWatermark for state in batch.stateOperators)

    def onQueryTerminated(self, event: object) -> None:
        self.over.set()


def late_rows(spark: SparkSession, start: Callable[[], StreamingQuery], wait: float = 60.0) -> int:
    """Run a query to its end and return how many rows it dropped as too late.

    The listener hears of the end after all batches. No other query may run in the session meanwhile,
    since a listener hears of all of them.
    """
    dropped = DroppedRows()
    spark.streams.addListener(dropped)
    try:
        start().awaitTermination()
        if not dropped.over.wait(wait):
            raise TimeoutError("the end of the query was not reported")
    finally:
        spark.streams.removeListener(dropped)
    return sum(dropped.by_batch.values())


def run_dedup(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Deduplicate everything available now and read the result back.

    Events later than the delay cannot be told from replays; if there are any, this is an error.
    """
    root = scratch_path(spark, "stream-dedup")
    stream = dedup_stream(events)
    late = late_rows(spark, lambda: append_to_table(stream, f"{root}/rows", f"{root}/_checkpoint"))
    if late:
        raise ValueError(f"{late} events came more than {REPLAY_DELAY} late")
    found = spark.read.schema(stream.schema).parquet(f"{root}/rows")
    return found.withColumn("ts", utc_wall_clock(F.col("ts")))


def run_daily_volume(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Daily volume of everything available now, late events included."""
    return count_days(spark, events).total(spark)


def count_days(spark: SparkSession, events: DataFrame, delay: str = LATE_EVENTS, root: str | None = None) -> DailyCounts:
    """Count everything available now; ``root`` names an earlier run to go on with."""
    root = root or scratch_path(spark, "stream-volume")
    counts = DailyCounts(f"{root}/rows", delay)
    writer = events.writeStream.foreachBatch(counts.merge).option("checkpointLocation", f"{root}/_checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return counts


def run_upsert(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Latest event per user, merged micro-batch by micro-batch."""
    root = scratch_path(spark, "stream-upsert")
    newest = lambda: (F.desc("ts"), F.desc("event_id"))
    sink = KeyedUpserts(f"{root}/rows", SCHEMAS["events"], "user_id", newest)
    rows = events.withColumn("ts", utc_wall_clock(F.col("ts")))
    return sink.run(rows, f"{root}/_checkpoint")
