"""The month-scoped merge: same facts as the plain merge, other months' files untouched, no shuffle by order."""

from __future__ import annotations

import uuid
from datetime import date, datetime
from pathlib import Path

import pytest
from conftest import rows

from shelfwatch.catalog import queries
from shelfwatch.operators import history
from shelfwatch.plans.models import FACT_COLUMNS, STORED_FACTS

FACT = STORED_FACTS.rsplit(",", 1)[0]


def fact(order, day, revenue=1.0):
    return (order, order and order % 5, 1, day and datetime.combine(day, datetime.min.time()), day, "done", "web", "DE", revenue, 1)


@pytest.fixture
def store(spark, tmp_path):
    held = history.FactStore(spark, f"facts_{uuid.uuid4().hex}", str(tmp_path / "facts"))
    yield held
    held.forget()


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_merge_changes_only_its_months(spark, store):
    old = [fact(i, date(2024, 1 + i % 6, 3)) for i in range(60)] + [fact(100, date(2023, 1, 1)), fact(101, None), fact(None, date(2024, 1, 4)), fact(None, None)]
    new = [fact(6, date(2024, 1, 9), 5.0), fact(7, date(2024, 9, 1), 6.0), fact(100, date(2024, 9, 2), 7.0), fact(200, date(2024, 9, 3)), fact(None, date(2024, 9, 4))]
    target, source = (spark.createDataFrame(x, FACT) for x in (old, new))
    store.create(target)
    before, name = files(store.path), f"recent_{uuid.uuid4().hex}"
    staged = store.stage(source, name)
    touched = store.merge(staged)
    # Order 7 leaves February, 100 leaves a month that is then empty, 6 stays in January.
    assert touched == [date(2023, 1, 1), date(2024, 1, 1), date(2024, 2, 1), date(2024, 9, 1)]
    after = files(store.path)
    kept = {f: t for f, t in before.items() if not any(f.startswith(f"order_month={m}") for m in touched)}
    assert kept and kept.items() <= after.items()
    assert not any(f.startswith("order_month=2023-01-01") for f in after)
    expected = rows(history.upsert(target, source).select(*FACT_COLUMNS))
    assert rows(store.read().select(*FACT_COLUMNS)) == expected
    assert store.merge(staged) == [date(2024, 1, 1), date(2024, 9, 1)]  # once more: nothing changes but new files
    assert rows(store.read().select(*FACT_COLUMNS)) != [] and rows(store.forget(name).where("order_id is not null")) == [r for r in expected if r[0] is not None]


def test_merge_joins_without_a_shuffle(spark, store):
    store.create(spark.createDataFrame([fact(i, date(2024, 1, 3)) for i in range(9)], FACT))
    name = f"recent_{uuid.uuid4().hex}"
    staged = store.stage(spark.createDataFrame([fact(3, date(2024, 1, 5))], FACT), name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = store.read().join(staged.select("order_id"), "order_id", "left_anti")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        months = store.months(staged)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql(f"DROP TABLE {name}")
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    assert "hashpartitioning(order_id" not in months and months.count("Exchange") == 2  # months alone move


def test_empty_source_and_first_load(spark, store):
    store.create(spark.createDataFrame([], FACT))
    empty, first = f"recent_{uuid.uuid4().hex}", f"recent_{uuid.uuid4().hex}"
    assert store.merge(store.stage(spark.createDataFrame([], FACT), empty)) == []
    assert store.merge(store.stage(spark.createDataFrame([fact(1, date(2024, 1, 3))], FACT), first)) == [date(2024, 1, 1)]
    assert store.forget(empty, first).count() == 1


def test_guard_reads_the_staged_rows(spark, store, tmp_path):
    """Revenue and versions are read once, by the write of the staged rows."""
    revenue = [fact(1, date(2024, 5, 1)), fact(2, date(2024, 5, 2)), fact(3, date(2023, 5, 2))]
    version = lambda c, start: (c, "a", "b", "e", "t", "DE", start, date(9999, 12, 31), True)
    schema = "customer_id bigint, first_name string, last_name string, email string, customer_type string, country_code string, valid_from date, valid_to date, is_current boolean"
    versions = spark.createDataFrame([version(1, date(2020, 1, 1)), version(1, date(2024, 1, 1)), version(2, date(2020, 1, 1))], schema)
    reads = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            reads.add(len(part))
            yield part

    facts = spark.createDataFrame(revenue, FACT).coalesce(1).mapInPandas(counted, FACT)
    store.create(spark.createDataFrame([fact(2, date(2024, 5, 2), 9.0), fact(3, date(2023, 5, 2))], FACT))
    one, two = f"recent_{uuid.uuid4().hex}", f"recent_{uuid.uuid4().hex}"
    with pytest.raises(history.DuplicateMergeKeys, match="1 recent orders are multiplied"):
        history.stored_merge(store, facts, versions, date(2024, 1, 1), one)
    assert reads.value == 3 and rows(store.read().select("order_id", "order_revenue")) == [(2, 9.0), (3, 1.0)]
    assert history.stored_merge(store, facts, versions, date(2024, 1, 1), two, repair=True) == [date(2024, 5, 1)]
    assert reads.value == 6
    assert rows(store.forget(one, two).select("order_id", "order_revenue")) == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_buckets_grow_with_the_stored_orders(spark, data, monkeypatch):
    few = queries.QUERIES["fct_orders_incremental_merge"](queries.Tables(spark, data))
    monkeypatch.setattr(queries.storage, "table_state", lambda spark, folder, name: (0, 464 << 20, 1))
    many = queries.QUERIES["fct_orders_incremental_merge"](queries.Tables(spark, data))
    buckets = {f.rsplit("_", 1)[1].split(".")[0] for f in many.inputFiles()}
    # About 5.2 shuffled bytes for each stored one, all of a bucket in one task.
    assert 5.2 * (464 << 20) / len(buckets) < 500 << 20
    assert len({f.rsplit("_", 1)[1].split(".")[0] for f in few.inputFiles()}) == 1
    assert rows(many) == rows(few)
