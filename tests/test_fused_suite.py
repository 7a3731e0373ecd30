"""The fused suite against its tests one by one: equal verdicts from fewer scans."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwatch.catalog.queries import QUERIES, tables
from shelfwatch.operators import checks


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_one_pass_per_table_and_equal_verdicts(spark):
    items = spark.createDataFrame(
        [(1, 10, 5), (2, 10, None), (3, 11, 6), (3, 11, 7), (4, None, 6), (5, 12, 6), (None, 12, 5)],
        "item long, order_id long, product long",
    )
    products = spark.createDataFrame([(5,), (5,), (None,)], "id long")
    window = spark.createDataFrame([(10,), (11,), (11,), (None,)], "order_id long")
    shared = {"items": items, "products": products, "window": window}
    product = ("items", "product", "products", "id")
    found = checks.fused_suite(
        shared,
        [
            checks.RowTest("no_order", "items", F.col("order_id").isNull()),
            checks.RowTest("never", "items", F.lit(False)),
            checks.KeyTest("item", "items", ("item",)),
            checks.KeyTest("late_item", "items", ("item",), F.col("product") > 6),
            checks.KeyTest("order_product", "items", ("order_id", "product")),
            checks.ReferenceTest("product", *product),
            checks.ReferenceTest("product_in_window", *product, "order_id", "window"),
        ],
    )
    orphans = checks.relationships(items, "product", products, "id", ["order_id"])
    alone = checks.suite(
        {
            "no_order": checks.not_null(items, "order_id", ["item"]),
            "never": items.where(F.lit(False)),
            "item": checks.unique(items, ["item"]),
            "late_item": checks.unique(items.where("product > 6"), ["item"]),
            "order_product": checks.unique(items, ["order_id", "product"]),
            "product": orphans,
            "product_in_window": orphans.join(window.distinct(), "order_id", "left_semi"),
        }
    )
    assert rows(found) == rows(alone)
    assert ("product_in_window", 3, False) in rows(found)


def test_empty_tables_pass_and_names_must_differ(spark):
    empty = spark.createDataFrame([], "k long, v long")
    shared = {"a": empty, "b": empty}
    tests = [
        checks.RowTest("rows", "a", F.col("v").isNull()),
        checks.KeyTest("keys", "a", ("k",)),
        checks.ReferenceTest("refs", "a", "k", "b", "k"),
        checks.ReferenceTest("refs_in", "a", "k", "b", "k", "v", "b"),
    ]
    assert rows(checks.fused_suite(shared, tests)) == [(n, 0, True) for n in ("keys", "refs", "refs_in", "rows")]
    with pytest.raises(ValueError, match="one name"):
        checks.fused_suite(shared, tests[:1] * 2)
    drifted = {"a": empty, "b": empty.withColumn("k", F.col("k").cast("string"))}
    with pytest.raises(TypeError, match="key types"):
        checks.fused_suite(drifted, tests[2:3])


def test_registered_suite_reads_each_table_once_per_load(spark, data):
    found = QUERIES["dq_suite"](tables(spark, data))
    assert scans(found) <= 10
    t = tables(spark, data)
    one_by_one = {name: QUERIES[name](t).count() for name in ("dq_not_null_customer", "orphans_in_window", "dq_fact_grain")}
    counts = {r["test_name"]: r["violations"] for r in found.collect()}
    assert len(counts) == 9 and one_by_one.items() <= counts.items()
