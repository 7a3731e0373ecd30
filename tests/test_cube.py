"""The stored daily cube: equal findings, loads added apart, replaced when repeated, and few table reads."""

from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwatch.catalog.queries import QUERIES, tables
from shelfwatch.operators import anomalies, cube

EVENT = "id long, ts timestamp_ntz, kind string, user long, value double"


def event(i, day, kind="a", user=1, value=1.25):
    return (i, day and datetime(2024, 1, day, i % 24), kind, user, value)


def cut(df):
    return cube.cells(df, "ts", "kind", "user", "value", 100.0)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture(scope="module")
def loads(spark):
    first = [event(i, 1 + i % 9, "ab"[i % 2], None if i % 7 == 0 else i, i / 4) for i in range(90)]
    second = [event(i, 9 + i % 5, "a", None, 500.0) for i in range(20)] + [event(3, 14, None, None, None)]
    return [spark.createDataFrame(x, EVENT) for x in (first, second)]


def test_detectors_on_cube_equal_detectors_on_table(spark, loads, tmp_path):
    held = cube.DailyCube(spark, str(tmp_path / "cube"))
    for name, part in zip(("one", "two"), loads, strict=True):
        held.add(name, cut(part))
    whole = loads[0].unionByName(loads[1])
    as_of = F.lit(date(2024, 1, 20))
    assert rows(held.volume_drop()) == rows(anomalies.volume_drop(whole))
    assert rows(held.null_rate_spike()) == rows(anomalies.null_rate_spike(whole, "user"))
    assert rows(held.distribution_shift()) == rows(anomalies.distribution_shift(whole, "kind"))
    assert rows(held.kpi_drop()) == rows(anomalies.kpi_drop(anomalies.daily_revenue(whole, "value")))
    assert rows(held.dimension_missing()) == rows(anomalies.dimension_missing(whole, "kind"))
    assert rows(held.freshness_gap(as_of)) == rows(anomalies.freshness_gap(whole, as_of))
    assert sum(r["above"] for r in held.outlier_days().collect()) == whole.where("value > 100").count()
    assert held.volume_drop().count() and held.dimension_missing().count()


def test_a_load_leaves_others_alone_and_replaces_itself(spark, loads, tmp_path):
    path = tmp_path / "cube"
    held = cube.DailyCube(spark, str(path))
    held.add("one", cut(loads[0]))
    before = files(path)
    held.add("two", cut(loads[1]))
    assert before.items() <= files(path).items()
    once = rows(held.read())
    held.add("two", cut(loads[1]))
    assert rows(held.read()) == once
    with pytest.raises(ValueError, match="named"):
        held.add("../one", cut(loads[1]))


def test_empty_loads_and_rows_without_time(spark, loads, tmp_path):
    held = cube.DailyCube(spark, str(tmp_path / "cube"))
    held.add("none", cut(loads[0].limit(0)))
    assert rows(held.profile()) == []
    held.add("late", cut(spark.createDataFrame([event(1, None), event(2, 3, value=None)], EVENT)))
    found = held.profile().select("day", "row_count", "revenue").collect()
    assert {tuple(r) for r in found} == {(None, 1, 1.25), (date(2024, 1, 3), 1, None)}


def test_scores_read_the_tables_seldom(spark, data):
    plan = QUERIES["detection_scores"](tables(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("event_id" in line for line in lines) <= 2
    assert sum("cents" in line for line in lines) >= 6
