from __future__ import annotations

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwatch.session import scratch_path
from shelfwatch.sources.tables import SCHEMAS
from shelfwatch.streaming import jobs

START = datetime(2024, 1, 1)


def event(number, hours, user=1, value=1.0):
    return (number, START + timedelta(hours=hours), user, "view", value, "{}")


def folder_with(spark, tmp_path, *batches):
    """One file per batch, named so that the stream reads them in order."""
    for number, batch in enumerate(batches):
        path = tmp_path / f"part{number}"
        spark.createDataFrame(batch, SCHEMAS["events"]).coalesce(1).write.parquet(str(path))
        (source,) = path.glob("*.parquet")
        target = tmp_path / "in" / f"events-{number}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(source.read_bytes())
    return str(tmp_path / "in")


def test_replay_in_a_later_batch_is_dropped(spark, tmp_path):
    folder = folder_with(
        spark, tmp_path, [event(1, 0), event(2, 5)], [event(2, 5), event(3, 6)], [event(1, 0), event(4, 7)]
    )
    found = jobs.run_dedup(spark, jobs.read_events(spark, folder, files_per_batch=1))
    assert rows(found.select("event_id")) == [(1,), (2,), (3,), (4,)]


def test_daily_volume_includes_open_days(spark, tmp_path):
    folder = folder_with(spark, tmp_path, [event(1, 1), event(2, 2)], [event(3, 3), event(4, 30)])
    found = jobs.run_daily_volume(spark, jobs.read_events(spark, folder, files_per_batch=1))
    assert [(str(d), n) for d, n, _ in rows(found)] == [("2024-01-01", 3), ("2024-01-02", 1)]


def test_batches_out_of_order_change_nothing(spark, tmp_path):
    batches = [event(3, 24 * 9)], [event(1, 2)], [event(2, 1)]
    folder = folder_with(spark, tmp_path, *batches)
    for per_batch in (None, 1):
        volume = jobs.run_daily_volume(spark, jobs.read_events(spark, folder, per_batch))
        assert [(str(d), n) for d, n, _ in rows(volume)] == [("2024-01-01", 2), ("2024-01-10", 1)]
        latest = jobs.run_upsert(spark, jobs.read_events(spark, folder, per_batch))
        assert rows(latest.select("event_id")) == [(3,)]
        assert jobs.run_dedup(spark, jobs.read_events(spark, folder, per_batch)).count() == 3


def test_events_later_than_the_delay_are_refused(spark, tmp_path):
    folder = folder_with(spark, tmp_path, [event(1, 24 * 90)], [event(2, 24 * 91)], [event(3, 0)])
    with pytest.raises(ValueError, match="1 events"):
        jobs.run_dedup(spark, jobs.read_events(spark, folder, files_per_batch=1))


def test_no_input_gives_an_empty_table(spark, tmp_path):
    folder = folder_with(spark, tmp_path, [])
    assert jobs.run_upsert(spark, jobs.read_events(spark, folder)).count() == 0
    assert jobs.KeyedUpserts(str(tmp_path / "none"), "k bigint", "k").latest(spark).count() == 0
    assert jobs.DailyCounts(str(tmp_path / "none")).total(spark).count() == 0


def test_finished_days_are_appended_only_after_the_watermark(spark, tmp_path):
    folder = folder_with(spark, tmp_path, [event(1, 1), event(2, 25)], [event(3, 24 * 9)])
    root = scratch_path(spark, "volume-append")
    stream = jobs.daily_volume(jobs.read_events(spark, folder, files_per_batch=1))
    jobs.append_to_table(stream, f"{root}/rows", f"{root}/_checkpoint").awaitTermination()
    days = spark.read.schema(stream.schema).parquet(f"{root}/rows").select(F.col("day").cast("string"))
    assert rows(days) == [("2024-01-01",), ("2024-01-02",)]


def test_upsert_replaces_keys_batch_by_batch_and_restarts(spark, tmp_path):
    folder = folder_with(
        spark, tmp_path,
        [event(1, 1, user=1, value=1.0), event(2, 2, user=1, value=2.0), event(3, 1, user=2, value=3.0)],
        [event(4, 9, user=1, value=4.0), event(5, 9, user=3, value=5.0)],
    )
    stream = jobs.read_events(spark, folder, files_per_batch=1)
    found = jobs.run_upsert(spark, stream)
    assert rows(found.select("user_id", "event_id", "value")) == [(1, 4, 4.0), (2, 3, 3.0), (3, 5, 5.0)]


def test_repeating_a_batch_and_compacting_change_nothing(spark):
    root = scratch_path(spark, "repeat")
    sink = jobs.KeyedUpserts(f"{root}/a", "k bigint, v bigint", "k")
    first = spark.createDataFrame([(1, 1), (2, 1)], "k bigint, v bigint")
    second = spark.createDataFrame([(2, 2), (3, 2)], "k bigint, v bigint")
    sink.merge(first, 0)
    sink.merge(second, 1)
    sink.merge(second, 1)
    assert rows(sink.latest(spark)) == [(1, 1), (2, 2), (3, 2)]
    compacted = sink.compact(spark, f"{root}/b")
    assert rows(compacted.latest(spark)) == [(1, 1), (2, 2), (3, 2)]
    compacted.merge(spark.createDataFrame([(1, 9)], "k bigint, v bigint"), 2)
    assert rows(compacted.latest(spark)) == [(1, 9), (2, 2), (3, 2)]


def test_copies_can_be_combined_before_the_state(spark, tmp_path):
    folder = folder_with(spark, tmp_path, [event(1, 0)] * 50 + [event(2, 1)], [event(1, 0), event(3, 2)])
    stream = jobs.dedup_stream(jobs.read_events(spark, folder, 1), combine_first=True)
    root = scratch_path(spark, "combine")
    jobs.append_to_table(stream, f"{root}/rows", f"{root}/_checkpoint").awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{root}/rows")
    assert rows(found.select("event_id")) == [(1,), (2,), (3,)]


def test_batch_and_stream_twins_agree(spark, data):
    stream = jobs.run_dedup(spark, jobs.read_events(spark, data))
    batch = jobs.dedup_batch(spark.read.schema(SCHEMAS["events"]).parquet(f"{data}/events.parquet"))
    assert stream.count() == batch.count() == 1000


def test_days_do_not_depend_on_the_session_zone(spark, data):
    utc = rows(jobs.run_daily_volume(spark, jobs.read_events(spark, data)))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(jobs.run_daily_volume(spark, jobs.read_events(spark, data))) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_folder_table_is_read(spark, tmp_path):
    table = tmp_path / "in" / "events.parquet"
    spark.createDataFrame([event(1, 0), event(2, 5), event(2, 5)], SCHEMAS["events"]).repartition(2).write.parquet(str(table))
    found = jobs.run_dedup(spark, jobs.read_events(spark, str(tmp_path / "in")))
    assert rows(found.select("event_id")) == [(1,), (2,)]


def test_late_events_are_counted_apart(spark, tmp_path):
    """The third day finishes the first; what comes for it afterwards is late, in every order it is in the total."""
    batches = [event(1, 1), event(2, 2)], [event(3, 24 * 4)], [event(4, 3), event(5, 24 * 3)], [event(6, 5)], [event(7, 24 * 9)]
    folder = folder_with(spark, tmp_path, *batches)
    counts = jobs.count_days(spark, jobs.read_events(spark, folder, files_per_batch=1))
    day = lambda n: f"2024-01-{n:02d}"
    assert sorted((str(d), n) for d, n, _ in rows(counts.total(spark))) == [(day(1), 4), (day(4), 1), (day(5), 1), (day(10), 1)]
    assert [(str(r["day"]), r["event_count"]) for r in counts.late(spark).orderBy("batch").collect()] == [(day(1), 1), (day(1), 1)]
    assert sorted((str(d), n, late) for d, n, late in rows(counts.finished(spark))) == [(day(1), 2, 2), (day(4), 1, 0), (day(5), 1, 0)]
    at_once = jobs.count_days(spark, jobs.read_events(spark, folder))
    assert rows(at_once.total(spark)) == rows(counts.total(spark)) and at_once.late(spark).count() == 0


def test_a_repeated_batch_meets_the_same_watermark(spark, tmp_path):
    counts = jobs.DailyCounts(str(tmp_path / "rows"))
    batch = lambda *events: spark.createDataFrame(events, SCHEMAS["events"]).withColumn("ts", jobs.utc_instant(F.col("ts")))
    counts.merge(batch(event(1, 0)), 0)
    counts.merge(batch(event(2, 24 * 9), event(3, 1)), 1)
    once = rows(counts.total(spark)), rows(counts.late(spark))
    counts.merge(batch(event(2, 24 * 9), event(3, 1)), 1)
    assert (rows(counts.total(spark)), rows(counts.late(spark))) == once and once[1] == []
    counts.merge(batch(event(4, 2)), 2)
    assert counts.late(spark).count() == 1
    counts.merge(batch(), 3)
    assert counts.total(spark).count() == 2


def test_drops_of_early_batches_are_not_forgotten(spark, tmp_path):
    """More batches than a query remembers, the late event in the third of them."""
    batches = [[event(1, 24 * 90)], [event(2, 24 * 91)], [event(3, 0)], *[[event(4 + i, 24 * 91 + i % 20)] for i in range(108)]]
    folder = tmp_path / "many"
    folder.mkdir()
    for number, batch in enumerate(batches):
        names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
        columns = [pa.array([r[i] for r in batch], pa.timestamp("us") if i == 1 else None) for i in range(6)]
        pq.write_table(pa.table(dict(zip(names, columns, strict=True))), folder / f"events-{number:03d}.parquet")
    with pytest.raises(ValueError, match="1 events"):
        jobs.run_dedup(spark, jobs.read_events(spark, str(folder), files_per_batch=1))
