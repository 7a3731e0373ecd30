"""Data-quality tests. Each returns the violating rows; no rows means passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.skew import split_join, union_all


def not_null(df: DataFrame, column: str, show: Sequence[str]) -> DataFrame:
    """Rows without a value; scans only the tested and the shown columns."""
    return df.where(F.col(column).isNull()).select(*show)


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (merged map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


def relationships(
    child: DataFrame,
    key: str,
    parent: DataFrame,
    parent_key: str,
    show: Sequence[str],
    hot: Sequence[Any] = (),
) -> DataFrame:
    """Child rows whose key is NULL or missing in the parent.

    Parent keys are reduced to distinct values map-side. ``hot`` names child keys
    that hold a large share of the rows; these are checked without a shuffle.
    """
    wanted = list(dict.fromkeys([key, *show]))
    parents = parent.select(F.col(parent_key).alias(key)).distinct()
    return union_all(split_join(child.select(*wanted), parents, key, "left_anti", hot)).select(*show)


def orphans_in_window(
    items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    start: date,
    end: date,
    hot_products: Sequence[Any] = (),
    hot_orders: Sequence[Any] = (),
) -> DataFrame:
    """Items of orders in a date window whose product does not exist."""
    window = (
        orders.where(F.col("order_date").between(F.lit(start), F.lit(end))).select("order_id").distinct()
    )
    lost = relationships(items, "product_id", products, "product_id", ["order_item_id", "order_id"], hot_products)
    return union_all(split_join(lost, window, "order_id", "left_semi", hot_orders)).select("order_item_id")


def accepted_values(df: DataFrame, column: str, values: Sequence[Any], show: Sequence[str] | None = None) -> DataFrame:
    """Rows whose value is outside the list or NULL."""
    return df.where(~F.col(column).isin(*values) | F.col(column).isNull()).select(*(show or [column]))


def expression(df: DataFrame, predicate: Column, show: Sequence[str]) -> DataFrame:
    """Rows for which the predicate is false; NULL is not a violation."""
    return df.where(~predicate).select(*show)


def not_empty(df: DataFrame) -> DataFrame:
    """One row when the table is empty, none otherwise.

    The count reads no columns; a global aggregate always yields a row to test.
    """
    return df.agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") == 0)


def column_type(df: DataFrame, column: str, expected: str) -> DataFrame:
    """Rows of a column whose type is not the expected one.

    The type is a property of the whole column, so a correct type folds to an
    empty relation at planning time and nothing is scanned.
    """
    return df.where(F.typeof(F.col(column)) != expected.lower()).select(column)


def key_types_match(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> None:
    """Refuse a join between keys of different types.

    Both sides of ``1 = '1'`` would be cast silently, which hides a drifted key.
    """
    found = left.schema[left_key].dataType, right.schema[right_key].dataType
    if found[0] != found[1]:
        raise TypeError(
            f"join key types differ: {left_key} {found[0].simpleString()}, "
            f"{right_key} {found[1].simpleString()}"
        )


def numeric_measure(df: DataFrame, column: str) -> None:
    """Refuse a measure that is not numeric; Spark would cast text silently."""
    found = df.schema[column].dataType.simpleString()
    if not found.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        raise TypeError(f"measure {column} has type {found}")


def suite(tests: Mapping[str, DataFrame]) -> DataFrame:
    """Name, number of violations and verdict of every test."""
    rows = [
        violations.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("test_name"), "violations", (F.col("violations") == 0).alias("passed")
        )
        for name, violations in tests.items()
    ]
    return union_all(rows)


@dataclass(frozen=True)
class RowTest:
    """Rows of ``table`` for which ``violated`` is true."""

    name: str
    table: str
    violated: Column


@dataclass(frozen=True)
class KeyTest:
    """Keys that occur more than once among the rows of ``table`` that ``where`` lets through."""

    name: str
    table: str
    keys: tuple[str, ...]
    where: Column | None = None


@dataclass(frozen=True)
class ReferenceTest:
    """Rows of ``table`` whose key is NULL or missing in ``parent``.

    With ``window``, a table of admitted values of the column ``through``, only rows that have one of these count.
    """

    name: str
    table: str
    key: str
    parent: str
    parent_key: str
    through: str | None = None
    window: str | None = None


SuiteTest = RowTest | KeyTest | ReferenceTest


def fused_suite(tables: Mapping[str, DataFrame], tests: Sequence[SuiteTest]) -> DataFrame:
    """Name, number of violations and verdict of every test, with one pass for all tests that can share one.

    All row tests of a table are counted in one aggregate; where the table has key tests too, the row counts ride
    on the grouping of the first key. Reference tests with the same child and parent share one anti join, and all
    windows look at its rows only, summed per value first. Both inputs of the anti join are plain shuffles, so
    adaptive execution splits a hot key.
    """
    if len({test.name for test in tests}) < len(tests):
        raise ValueError("two tests of a suite have one name")
    passes: list[DataFrame] = []
    for name in dict.fromkeys(test.table for test in tests):
        mine = [test for test in tests if test.table == name]
        row_tests = [test for test in mine if isinstance(test, RowTest)]
        key_tests = [test for test in mine if isinstance(test, KeyTest)]
        if key_tests:
            passes += _key_passes(tables[name], row_tests, key_tests)
        elif row_tests:
            passes.append(_counts(tables[name], {t.name: F.count_if(t.violated) for t in row_tests}))
        joins: dict[tuple, list[ReferenceTest]] = {}
        for test in mine:
            if isinstance(test, ReferenceTest):
                joins.setdefault((test.key, test.parent, test.parent_key), []).append(test)
        for group in joins.values():
            passes += _reference_passes(tables, group)
    return union_all(passes)


def _counts(df: DataFrame, counts: Mapping[str, Column]) -> DataFrame:
    """One verdict row per named aggregate, all from one aggregation of ``df``."""
    numbered = {f"test_{i}": count for i, count in enumerate(counts.values())}
    verdicts = F.array(
        *[
            F.struct(
                F.lit(name).alias("test_name"),
                F.coalesce(column, F.lit(0).cast("bigint")).alias("violations"),
                (F.coalesce(column, F.lit(0)) == 0).alias("passed"),
            )
            for name, column in zip(counts, numbered, strict=True)
        ]
    )
    return df.agg(*[count.alias(alias) for alias, count in numbered.items()]).select(F.inline(verdicts))


def _key_passes(df: DataFrame, row_tests: Sequence[RowTest], key_tests: Sequence[KeyTest]) -> list[DataFrame]:
    passes: list[DataFrame] = []
    for keys in dict.fromkeys(test.keys for test in key_tests):
        per_key: dict[str, Column] = {}
        final: dict[str, Column] = {}
        for test in key_tests:
            if test.keys == keys:
                alias = f"times_{len(per_key)}"
                per_key[alias] = F.count(F.lit(1)) if test.where is None else F.count_if(test.where)
                final[test.name] = F.count_if(F.col(alias) > 1)
        for test in row_tests if not passes else ():
            alias = f"rows_{len(per_key)}"
            per_key[alias] = F.count_if(test.violated)
            final[test.name] = F.sum(alias)
        grouped = df.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)])
        passes.append(_counts(grouped.agg(*[c.alias(a) for a, c in per_key.items()]), final))
    return passes


def _reference_passes(tables: Mapping[str, DataFrame], tests: Sequence[ReferenceTest]) -> list[DataFrame]:
    first = tests[0]
    child, parent = tables[first.table], tables[first.parent]
    key_types_match(child, first.key, parent, first.parent_key)
    throughs = list(dict.fromkeys(t.through for t in tests if t.window is not None))
    lost = child.select(F.col(first.key).alias("key"), *[F.col(c).alias(f"via_{i}") for i, c in enumerate(throughs)])
    lost = lost.join(parent.select(F.col(first.parent_key).alias("key")), "key", "left_anti")
    passes = []
    for i, through in enumerate(throughs or [None]):
        final = {t.name: F.sum("lost") for t in tests if t.window is None and i == 0}
        if through is None:
            passes.append(_counts(lost, {name: F.count(F.lit(1)) for name in final}))
            continue
        rows = lost.groupBy(F.col(f"via_{i}").alias("via")).agg(F.count(F.lit(1)).alias("lost"))
        windows = dict.fromkeys(t.window for t in tests if t.through == through and t.window is not None)
        for j, window in enumerate(windows):
            admitted = tables[window].select(F.col(through).alias("via")).distinct().withColumn(f"in_{j}", F.lit(True))
            rows = rows.join(admitted, "via", "left")
            for test in tests:
                if test.through == through and test.window == window:
                    final[test.name] = F.sum(F.when(F.col(f"in_{j}"), F.col("lost")))
        passes.append(_counts(rows, final))
    return passes
