"""Stored day sketches: exact counts, bounded errors in any window, loads apart, no read of the table."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwatch.operators import sketches

ROW = "ts timestamp_ntz, user long, kind string, value double"
COLUMNS = ["user", "kind", "value"]


@pytest.fixture(scope="module")
def table(spark):
    start = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    number = F.pmod(F.xxhash64("id"), F.lit(9000))
    return spark.range(60_000).select(
        (start + F.expr("make_dt_interval(cast(id % 20 as int))")).alias("ts"),
        F.when(F.col("id") % 11 != 0, number).alias("user"),
        F.concat(F.lit("k"), F.col("id") % 7).alias("kind"),
        (number * number / 100.0).alias("value"),
    )


@pytest.fixture(scope="module")
def store(spark, table, tmp_path_factory):
    held = sketches.SketchStore(spark, str(tmp_path_factory.mktemp("sketches")))
    for load, part in {"one": table.where("user < 4000"), "two": table.where("user >= 4000 or user is null")}.items():
        held.add(load, sketches.day_sketches(part, "ts", COLUMNS))
    return held


@pytest.mark.parametrize("first, length", [(1, 20), (3, 1), (7, 9)])
def test_window_meets_its_errors(store, table, first, length):
    start = date(2024, 1, first)
    end = start + timedelta(days=length - 1)
    inside = table.where(F.col("ts").cast("date").between(F.lit(start), F.lit(end)))
    found = {r["name"]: r for r in store.window(start, end).collect()}
    assert set(found) == set(COLUMNS)
    for name in COLUMNS:
        exact = inside.agg(
            F.count(F.lit(1)), F.round(F.avg(F.col(name).isNull().cast("double")), 6), F.countDistinct(name)
        ).first()
        assert (found[name]["row_count"], found[name]["null_rate"]) == tuple(exact)[:2]
        assert abs(found[name]["distinct_count"] - exact[2]) <= 4 * sketches.DISTINCT_ERROR * exact[2]
    for name in ("user", "value"):
        ends = inside.agg(F.min(name).cast("double"), F.max(name).cast("double")).first()
        assert (found[name]["low"], found[name]["high"]) == tuple(ends)
        for share, value in zip((0.25, 0.5, 0.75), found[name]["quantiles"], strict=True):
            error = inside.agg(sketches.order_error(name, share, F.lit(value))).first()[0]
            assert error <= 2 * sketches.ORDER_ERROR
    assert found["kind"]["quantiles"] is None and found["kind"]["low"] is None


def test_profiles_read_the_store_only(store):
    plan = store.window(date(2024, 1, 1), date(2024, 1, 9))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "order_sketch" in plan and "ts#" not in plan


def test_repeated_load_replaces_itself_and_names_are_checked(spark, store, table):
    counts = lambda: rows(store.days().select("day", "name", "row_count", "distinct_count"))
    before = counts()
    store.add("two", sketches.day_sketches(table.where("user >= 4000 or user is null"), "ts", COLUMNS))
    assert counts() == before
    with pytest.raises(ValueError, match="named"):
        store.add("../one", sketches.day_sketches(table, "ts", COLUMNS))


def test_nulls_nan_and_empty_loads(spark, tmp_path):
    held = sketches.SketchStore(spark, str(tmp_path / "store"))
    day = datetime(2024, 1, 2, 5)
    nan = float("nan")
    awkward = [(day, None, None, nan), (day, None, "a", 2.0), (None, 7, "b", 3.0)]
    held.add("none", sketches.day_sketches(spark.createDataFrame([], ROW), "ts", COLUMNS))
    assert held.window(date(2024, 1, 1), date(2024, 1, 3)).collect() == []
    held.add("some", sketches.day_sketches(spark.createDataFrame(awkward, ROW), "ts", COLUMNS))
    found = {r["name"]: tuple(r)[1:] for r in held.window(date(2024, 1, 1), date(2024, 1, 3)).collect()}
    assert found["user"] == (2, 1.0, 0, None, None, None)
    assert found["kind"] == (2, 0.5, 1, None, None, None)
    assert found["value"] == (2, 0.0, 2, 2.0, 2.0, [2.0, 2.0, 2.0])
    assert held.days().where("day is null and name = 'user'").first()["distinct_count"] == 1
