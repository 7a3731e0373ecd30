from __future__ import annotations

import shutil
from datetime import date
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwatch.catalog.queries import runnable
from shelfwatch.functions.skew import heavy_keys, split_join, union_all
from shelfwatch.operators import anomalies, checks, history, profile
from shelfwatch.plans import dashboard
from shelfwatch.plans.models import FACT_COLUMNS, read_facts, write_facts
from shelfwatch.session import scratch_path
from shelfwatch.sources.tables import save_bucketed


def test_heavy_keys_finds_the_hot_key_and_null(spark):
    skewed = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k")
    )
    assert set(heavy_keys(skewed, "k", share=0.05)) == {7, None}
    assert set(heavy_keys(skewed, "k")) == {7, None}
    assert heavy_keys(spark.range(1000).withColumnRenamed("id", "k"), "k") == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(spark, how):
    left = spark.createDataFrame(
        [(k, n) for n, k in enumerate([1, 1, 1, 2, 3, None, None, 9])], "k bigint, n bigint"
    )
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k bigint, v string")
    plain = rows(left.join(right, "k", how))
    for hot in ((), (1,), (1, None), (None,), (9, 4)):
        assert rows(union_all(split_join(left, right, "k", how, hot))) == plain


def test_relationships_reports_null_and_unknown_keys(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99), (4, 10)], "id bigint, product_id bigint")
    parent = spark.createDataFrame([(10,), (10,)], "product_id bigint")
    for hot in ((), (10,), (99, None)):
        found = checks.relationships(child, "product_id", parent, "product_id", ["id"], hot)
        assert rows(found) == [(2,), (3,)]


def test_accepted_values_expression_and_not_empty(spark):
    df = spark.createDataFrame([("web", 1.0), ("x", -1.0), (None, None)], "channel string, price double")
    assert rows(checks.accepted_values(df, "channel", ["web"])) == [("x",), (None,)]
    assert rows(checks.expression(df, F.col("price") >= 0, ["channel"])) == [("x",)]
    assert checks.not_empty(df).count() == 0
    assert checks.not_empty(df.where("1 = 0")).count() == 1


def test_type_check_scans_nothing_when_the_type_is_right(spark, data):
    df = spark.read.parquet(f"{data}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("d"))
    right = checks.column_type(df, "d", "DATE")
    assert "LocalTableScan <empty>" in right._jdf.queryExecution().toString()
    assert checks.column_type(df.select(F.col("d").cast("string").alias("d")), "d", "DATE").count() == 1500


def test_suite_names_counts_and_verdicts(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k bigint")
    found = checks.suite({"unique": checks.unique(df, ["k"]), "set": checks.not_null(df, "k", ["k"])})
    assert rows(found) == [("set", 0, True), ("unique", 1, False)]


VERSION = (
    "customer_id bigint, first_name string, last_name string, email string, customer_type string, "
    "country_code string, valid_from date, valid_to date, is_current boolean"
)
FACT = (
    "order_id bigint, customer_id bigint, store_id bigint, order_timestamp timestamp_ntz, order_date date, "
    "order_status string, channel string, country_code string, order_revenue double, total_quantity bigint"
)
OPEN = date(9999, 12, 31)


def version(customer, start, end=OPEN, name="a"):
    return (customer, name, "b", "c", "vip", "FR", start, end, True)


def fact(order_id, customer, day, amount=1.0):
    return (order_id, customer, 1, None, day, "completed", "web", "FR", amount, 1)


def test_overlaps_are_found_and_closed(spark):
    versions = spark.createDataFrame(
        [
            version(1, date(2026, 1, 1)),
            version(1, date(2026, 3, 1)),
            version(2, date(2026, 1, 1), date(2026, 1, 31)),
            version(2, date(2026, 2, 1)),
            version(3, date(2026, 1, 1)),
            version(3, date(2026, 1, 1), name="z"),
        ],
        VERSION,
    )
    found = history.overlapping_versions(versions).select("customer_id").collect()
    assert sorted(r[0] for r in found) == [1, 3]
    closed = history.close_versions(versions)
    assert history.overlapping_versions(closed).count() == 0
    kept = rows(closed.select("customer_id", "first_name", "valid_from", "valid_to", "is_current"))
    assert kept == [
        (1, "a", date(2026, 1, 1), date(2026, 2, 28), False),
        (1, "a", date(2026, 3, 1), OPEN, True),
        (2, "a", date(2026, 1, 1), date(2026, 1, 31), False),
        (2, "a", date(2026, 2, 1), OPEN, True),
        (3, "z", date(2026, 1, 1), OPEN, True),
    ]


def test_guard_stops_the_merge_and_repair_lets_it_pass(spark):
    start = date(2026, 8, 15)
    revenue = spark.createDataFrame(
        [fact(1, 1, date(2026, 8, 20), 9.0), fact(2, 2, date(2026, 8, 1)), fact(3, None, date(2026, 8, 21))], FACT
    )
    versions = spark.createDataFrame([version(1, date(2026, 1, 1)), version(1, date(2026, 2, 1))], VERSION)
    target = spark.createDataFrame([fact(1, 1, date(2026, 7, 1), 5.0), fact(2, 2, date(2026, 8, 1))], FACT)
    with pytest.raises(history.DuplicateMergeKeys, match="1 recent orders are multiplied"):
        history.incremental_merge(target, revenue, versions, start)
    merged = history.incremental_merge(target, revenue, versions, start, repair=True)
    assert rows(merged.select("order_id", "order_date", "order_revenue")) == [
        (1, date(2026, 8, 20), 9.0),
        (2, date(2026, 8, 1), 1.0),
        (3, date(2026, 8, 21), 1.0),
    ]
    closed = history.close_versions(versions)
    assert rows(history.incremental_merge(target, revenue, closed, start)) == rows(merged)
    assert history.incremental_source(revenue, versions, start).count() == 3


def test_rank_is_limited_before_the_shuffle(spark):
    revenue = spark.createDataFrame([fact(1, 1, date(2026, 8, 20))], FACT)
    versions = spark.createDataFrame([version(1, date(2026, 1, 1))], VERSION)
    plan = history.full_refresh(revenue, versions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert history.full_refresh(revenue, versions).columns == list(FACT_COLUMNS)


def test_dashboard_defaults_and_allow_list(spark):
    facts = spark.createDataFrame([fact(1, 1, date(2026, 8, 20)), fact(2, 1, date(2026, 8, 22))], FACT)
    filters = dashboard.with_default_dates(facts, None, date(2026, 8, 21))
    assert (filters.start, filters.end) == (date(2026, 8, 20), date(2026, 8, 21))
    assert rows(dashboard.kpis(facts, filters)) == [(1, 1, 1.0, 1.0)]
    with pytest.raises(ValueError, match="Unsupported breakdown"):
        dashboard.breakdown(facts, "customer_id", filters)


def test_refresh_day_lags_behind_the_facts(spark):
    facts = spark.createDataFrame([fact(1, 1, date(2026, 8, 20)), fact(2, 1, date(2026, 8, 22))], FACT)
    daily = spark.createDataFrame([(date(2026, 8, 21),)], "order_date date")
    assert rows(dashboard.filter_bounds(facts, daily)) == [(date(2026, 8, 20), date(2026, 8, 22), date(2026, 8, 21))]


def test_replaced_tables_give_new_results(spark, data, tmp_path):
    folder = tmp_path / "tables"
    folder.mkdir()  # the given folder and its files may be read-only, so only contents are copied
    for path in Path(data).iterdir():
        shutil.copyfile(path, folder / path.name)
    orders = spark.read.parquet(f"{data}/orders.parquet")
    before = runnable()["kpis"](spark, str(folder)).first()["orders"]
    orders.where("o_orderkey % 2 = 0").write.parquet(str(tmp_path / "half"))
    (folder / "orders.parquet").unlink()
    shutil.copytree(tmp_path / "half", folder / "orders.parquet")
    after = runnable()["kpis"](spark, str(folder)).first()["orders"]
    assert 0 < after < before
    assert after == runnable()["fct_orders"](spark, str(folder)).count()


def test_read_only_statements(spark):
    spark.range(200).createOrReplaceTempView("numbers")
    assert profile.run_read_only(spark, "SELECT id FROM numbers;").count() == 100
    assert profile.run_read_only(spark, "with x as (select * from numbers) select * from x limit 150").count() == 100
    assert profile.run_read_only(spark, "select id as limit_id from numbers").count() == 100
    for statement in ("INSERT INTO numbers VALUES (1)", "select 1; drop table numbers", "selection"):
        with pytest.raises(ValueError):
            profile.run_read_only(spark, statement)


def test_find_table_and_profile(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    assert profile.find_table(spark, "numbers").count() == 10
    with pytest.raises(LookupError):
        profile.find_table(spark, "no_such_table")
    df = spark.createDataFrame([(1,), (1,), (None,), (3,)], "order_id bigint")
    assert rows(profile.table_profile(df)) == [(4, 0.25, 2)]
    assert rows(profile.table_profile(df, approximate=True)) == [(4, 0.25, 2)]
    with pytest.raises(ValueError):
        profile.metric_history(df, "revenue")


def test_detection_scores_are_zero_safe(spark):
    truth = spark.createDataFrame([("a",), ("b",)], "anomaly_type string")
    none = truth.where("1 = 0")
    assert rows(anomalies.detection_scores(none, truth)) == [(0.0, 0.0, 0.0, 0, 0, 2)]
    assert rows(anomalies.detection_scores(none, none)) == [(0.0, 0.0, 0.0, 0, 0, 0)]
    found = spark.createDataFrame([("a",), ("a",), ("x",)], "anomaly_type string")
    assert rows(anomalies.detection_scores(found, truth)) == [(0.5, 0.5, 0.5, 1, 1, 1)]


def test_orphan_rate_and_missing_status_with_hot_keys(spark):
    day = date(2026, 8, 18)
    orders = spark.createDataFrame(
        [(1, day, "completed"), (1, day, "completed"), (2, day, "shipped"), (3, day, "pending"), (4, day, "shipped")],
        "order_id bigint, order_date date, order_status string",
    )
    items = spark.createDataFrame([(1, 10), (1, 99), (2, 10), (3, 99)], "order_id bigint, product_id bigint")
    products = spark.createDataFrame([(10,)], "product_id bigint")
    facts = spark.createDataFrame([(2,)], "order_id bigint")
    accepted = ("completed", "confirmed", "shipped")
    for hot in ((), (1, 2), (99, None)):
        rate = anomalies.orphan_rate(items, orders, products, 0.05, hot, hot)
        assert rows(rate) == [(day, 6, 3, 0.5)]
        missing = anomalies.missing_status(orders, items, facts, accepted, hot)
        assert rows(missing) == [(day, "completed", 2)]


def test_upsert_with_hot_keys(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "order_id bigint, v string")
    source = spark.createDataFrame([(1, "x"), (3, "y")], "order_id bigint, v string")
    for hot in ((), (1,), (2, None)):
        assert rows(history.upsert(target, source, hot=hot)) == [(1, "x"), (2, "c"), (3, "y"), (None, "n")]


def test_bucketed_tables_join_without_a_shuffle(spark):
    base = scratch_path(spark, "bucketed")
    left = save_bucketed(spark.range(50).withColumnRenamed("id", "order_id"), "b_orders", "order_id", 4, f"{base}/o")
    items = spark.range(100).selectExpr("id % 50 as order_id", "id as item")
    right = save_bucketed(items, "b_items", "order_id", 4, f"{base}/i")
    joined = left.hint("merge").join(right, "order_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100
    spark.sql("drop table b_orders")
    spark.sql("drop table b_items")


def test_merged_snapshot_keeps_the_previous_one(spark):
    base = scratch_path(spark, "snapshots")
    old = spark.createDataFrame([fact(1, 1, date(2026, 7, 1), 5.0), fact(2, 2, date(2026, 8, 1))], FACT)
    write_facts(old, f"{base}/v1")
    revenue = spark.createDataFrame([fact(1, 1, date(2026, 8, 20), 9.0)], FACT)
    versions = spark.createDataFrame([version(1, date(2026, 1, 1))], VERSION)
    new = history.merge_snapshot(f"{base}/v1", f"{base}/v2", revenue, versions, date(2026, 8, 15))
    expected = [(1, date(2026, 8, 1), 9.0), (2, date(2026, 8, 1), 1.0)]
    assert rows(new.select("order_id", "order_month", "order_revenue")) == expected
    assert rows(read_facts(spark, f"{base}/v1").drop("order_month")) == rows(old)


def test_adaptive_execution_splits_a_hot_customer(spark):
    """The temporal join relies on it: both of its sides are plain shuffles."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    before = {key: spark.conf.get(key, None) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        day = F.lit(date(2026, 8, 20))
        orders = spark.range(0, 60000, 1, 8).select(
            F.col("id").alias("order_id"),
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("customer_id"),
            day.alias("order_date"),
        )
        versions = spark.range(20000).select(
            F.col("id").alias("customer_id"), day.alias("valid_from"), day.alias("valid_to")
        )
        joined = history.temporal_join(orders, versions)
        assert joined.count() == 60000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
