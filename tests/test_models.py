from __future__ import annotations

from datetime import date, datetime
from itertools import product

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException, ArithmeticException, ParseException
from pyspark.sql import functions as F

from shelfwatch.catalog import queries
from shelfwatch.config import MissingSetting, Settings, required_env
from shelfwatch.operators import checks
from shelfwatch.plans import models
from shelfwatch.plans.models import Warehouse, write_facts
from shelfwatch.session import scratch_path
from shelfwatch.sources.retail import RawTables

ORDERS = (
    "order_id bigint, customer_id double, store_id bigint, order_timestamp timestamp_ntz, "
    "order_date date, status string, channel string, country_code string"
)
ITEMS = (
    "order_item_id bigint, order_id bigint, product_id bigint, quantity int, unit_price double, "
    "line_amount double"
)
RULE = Settings(exclude_confirmed_from=date(2026, 8, 20))


def order(order_id, customer=1.0, day=1, status="completed", channel="web"):
    return (order_id, customer, 1, datetime(2026, 8, day), date(2026, 8, day), status, channel, "FR")


def item(number, order_id, amount, quantity=1):
    return (number, order_id, 1, quantity, amount, amount)


def revenue(spark, orders, items, setting=RULE, hot=()):
    staged = models.stg_orders(spark.createDataFrame(orders, ORDERS))
    lines = models.stg_order_items(spark.createDataFrame(items, ITEMS))
    return models.int_order_revenue(staged, lines, setting, hot)


def brute_force(orders, items, setting=RULE):
    """Join every order row with every item of the order, then group."""
    groups = {}
    for o, i in product(orders, items):
        late = setting.exclude_confirmed_from and o[4] >= setting.exclude_confirmed_from
        if o[0] != i[1] or o[5] not in setting.accepted_statuses or (late and o[5] == "confirmed"):
            continue
        key = (o[0], None if o[1] is None else int(o[1]), *o[2:])
        cents, units = groups.get(key, (0, 0))
        groups[key] = (cents + round(i[5] * 100), units + i[3])
    return sorted(((*k, c / 100, u) for k, (c, u) in groups.items()), key=repr)


def test_exclusion_applies_to_confirmed_orders_from_its_day(spark):
    orders = [
        order(1, day=19, status="confirmed"),
        order(2, day=20, status="confirmed"),
        order(3, day=20, status="shipped"),
        order(4, day=1, status="pending"),
    ]
    items = [item(n, n, 10.0) for n in (1, 2, 3, 4)]
    assert {r.order_id for r in revenue(spark, orders, items).collect()} == {1, 3}
    without = revenue(spark, orders, items, Settings(exclude_confirmed_from=None))
    assert {r.order_id for r in without.collect()} == {1, 2, 3}


def test_copies_count_revenue_once_per_copy(spark):
    orders = [order(7), order(7), order(7, channel="store")]
    items = [item(1, 7, 10.25, 2), item(2, 7, 0.1)]
    found = {r.channel: (r.order_revenue, r.total_quantity) for r in revenue(spark, orders, items).collect()}
    assert found == {"web": (20.7, 6), "store": (10.35, 3)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(1, 4), st.sampled_from([1.0, None]), st.integers(1, 28),
                       st.sampled_from(["completed", "confirmed", "pending"])), max_size=12),
    st.lists(st.tuples(st.integers(1, 5), st.integers(1, 9999)), max_size=12),
)
def test_revenue_equals_brute_force_with_and_without_hot_keys(spark, order_rows, item_rows):
    orders = [order(i, c, d, s) for i, c, d, s in order_rows]
    items = [item(n, i, cents / 100) for n, (i, cents) in enumerate(item_rows)]
    expected = brute_force(orders, items)
    for hot in ((), (2,), (1, 3, 99)):
        assert rows(revenue(spark, orders, items, hot=hot)) == expected


def test_customers_without_orders_keep_a_row(spark):
    customers = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    found = rows(models.int_customer_orders(customers, revenue(spark, [order(1)], [item(1, 1, 5.0)])))
    day = date(2026, 8, 1)
    assert found == [(1, 1, 5.0, day, day), (2, 0, 0.0, None, None)]


def test_marts_round_trip_and_month_pruning(spark, data):
    house = Warehouse(RawTables(spark, data), Settings(exclude_confirmed_from=date(2000, 1, 1)))
    stored = write_facts(house.fct_orders, scratch_path(spark, "facts"))
    assert rows(stored.drop("order_month")) == rows(house.fct_orders)
    from shelfwatch.plans.dashboard import Filters, kpis

    plan = kpis(stored, Filters(date(1997, 1, 1), date(1997, 1, 31)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    with pytest.raises(AnalysisException):
        write_facts(stored, stored.inputFiles()[0].rsplit("/order_month", 1)[0])


def test_overwriting_a_mart_replaces_it(spark, data):
    house = Warehouse(RawTables(spark, data))
    path = scratch_path(spark, "marts")
    first = {n: df.count() for n, df in house.write_marts(path).items()}
    second = {n: df.count() for n, df in house.write_marts(path, mode="overwrite").items()}
    assert first == second and set(first) == set(Warehouse.MARTS)


@pytest.fixture(scope="module")
def views(spark, data):
    Warehouse(RawTables(spark, data)).register_views()
    return spark


@pytest.mark.parametrize(
    ("statement", "condition"),
    [
        ("select c.customer_segment from stg_customers c", "UNRESOLVED_COLUMN"),
        ("select normalise_money(order_revenue) from fct_orders", "UNRESOLVED_ROUTINE"),
        ("select * from raw_product", "TABLE_OR_VIEW_NOT_FOUND"),
        ("select o.order_revenu from int_order_revenue o", "UNRESOLVED_COLUMN"),
        ("selec order_id from stg_orders", "PARSE_SYNTAX_ERROR"),
        ("select sum(line_amount * quantity +) from stg_order_items", "PARSE_SYNTAX_ERROR"),
    ],
)
def test_broken_models_fail_with_a_named_condition(views, statement, condition):
    with pytest.raises((AnalysisException, ParseException)) as caught:
        views.sql(statement)
    assert condition in caught.value.getCondition()


def test_bad_date_literal_fails_and_try_cast_does_not(views):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        views.sql("select cast('not-a-date' as date) as d from stg_orders").collect()
    assert views.sql("select try_cast('not-a-date' as date) as d").first()["d"] is None


def test_missing_parameter_is_an_error(views, monkeypatch):
    with pytest.raises(Exception, match="UNBOUND_SQL_PARAMETER"):
        views.sql("select * from stg_orders where order_date >= :start").collect()
    bound = views.sql(
        "select count(*) as n from stg_orders where order_date >= :start", args={"start": date(1990, 1, 1)}
    )
    assert bound.first()["n"] == 1500
    monkeypatch.delenv("STORE_SOURCE", raising=False)
    with pytest.raises(MissingSetting, match="STORE_SOURCE"):
        required_env("STORE_SOURCE")
    assert required_env("STORE_SOURCE", "x") == "x"


def test_settings_from_environment(monkeypatch):
    monkeypatch.setenv("SHELFWATCH_EXCLUDE_CONFIRMED_FROM", "")
    monkeypatch.setenv("SHELFWATCH_RECENT_START", "2026-01-02")
    found = Settings.from_environment()
    assert found.exclude_confirmed_from is None and found.recent_start == date(2026, 1, 2)


def test_type_guards_find_silent_coercion(views):
    products, items = views.table("stg_products"), views.table("stg_order_items")
    checks.key_types_match(items, "product_id", products, "product_id")
    with pytest.raises(TypeError, match="product_id"):
        checks.key_types_match(
            items, "product_id", products.withColumn("product_id", F.col("product_id").cast("string")), "product_id"
        )
    checks.numeric_measure(items, "line_amount")
    with pytest.raises(TypeError):
        checks.numeric_measure(items.withColumn("line_amount", F.col("line_amount").cast("string")), "line_amount")


def test_cents_overflow_is_an_error_and_not_a_wrong_sum(spark):
    from shelfwatch.functions.money import money_sum

    huge = spark.range(4).select(F.lit(4e16).alias("amount"))
    with pytest.raises(ArithmeticException):
        huge.agg(money_sum("amount")).collect()


def test_doubled_facts_are_built_once(spark, data):
    t = queries.Tables(spark, data)
    facts, twice = queries.QUERIES["fct_orders"](t), queries.QUERIES["fact_grain_regression"](t)
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (facts, twice)]
    assert scans[0] == scans[1] > 0
    assert rows(twice) == rows(facts.unionByName(facts)) and twice.columns == facts.columns
