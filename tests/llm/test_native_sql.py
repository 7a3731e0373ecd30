"""The native operators against their SQL, and what their thresholds and orders are made of."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import mixing, quality
from shelfwatch.llm.catalog import ORACLES, QUERIES

SHAPE = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, folder):
    df = QUERIES[name](spark, folder)
    engine = duckdb.connect()
    engine.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    answer = engine.execute(ORACLES[name])
    place = {column[0]: i for i, column in enumerate(answer.description)}
    assert set(place) == set(df.columns)
    expected = sorted((tuple(r[place[c]] for c in df.columns) for r in answer.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == expected


def prose(i, marks):
    words = [f"word{(i * 31 + j * 7) % 997}" for j in range(40)]
    return " ".join(words) + "#" * marks


def test_limits_follow_the_source(spark):
    rows = [(i, prose(i, i % 10), "en", "plain") for i in range(400)]
    rows += [(1000 + i, prose(i, 40 + 8 * (i % 10)), "en", "code") for i in range(400)]
    measures = quality.measured(spark.createDataFrame(rows, SHAPE))
    found = {r["source"]: r for r in quality.limits(quality.sketches(measures)).where("rule = 'symbols'").collect()}
    assert found["code"]["high"] > 1.3 * found["plain"]["high"]
    assert not found["code"]["at_least"] and not found["plain"]["at_least"]


def test_most_groups_have_limits_of_their_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = quality.limits(quality.sketches(quality.measured(docs))).groupBy("rule").agg(
        F.avg(F.col("at_least").cast("int")).alias("share"), F.count_distinct("high").alias("limits")
    ).collect()
    assert len(found) == len(quality.RULES)
    assert all(r["share"] < 0.5 and r["limits"] > 5 for r in found), found


def test_grid_is_monotone_and_exact_below_256(spark):
    rows = spark.range(0, 70_000).select("id", quality._cell(F.col("id")).alias("cell"))
    rows = rows.withColumn("largest", quality._largest(F.col("cell"))).orderBy("id").collect()
    cells = [r["cell"] for r in rows]
    assert cells[:256] == list(range(256)) and all(b - a in (0, 1) for a, b in zip(cells, cells[1:]))
    assert all(r["largest"] >= r["id"] for r in rows) and all(r["largest"] <= r["id"] * 129 // 128 for r in rows)


def test_kept_documents_and_copies_have_their_columns_unchanged(spark):
    docs = spark.createDataFrame([(i, prose(i, 0), "en", "s") for i in range(30)], SHAPE)
    docs = docs.withColumns(
        {"n_words": F.lit(7), "kept": F.lit("mine"), "__key": F.lit("keep"), "__words": F.lit(1), "helper_0": F.lit(2)}
    )
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 30
    assert {tuple(r)[4:] for r in kept.collect()} == {(7, "mine", "keep", 1, 2)}
    mixed = mixing.mixed(docs)
    assert {r["__key"] for r in mixed.collect()} == {"keep"}


def test_equal_rows_without_id_spread_over_partitions(spark):
    # A null id is drawn by its text, so equal rows all get the same number of copies.
    docs = spark.createDataFrame([(None, f"text {i % 3}", "en", "s") for i in range(6000)], SHAPE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = mixing.mixed(docs).withColumn("part", F.spark_partition_id())
        largest = placed.groupBy("text", "copy", "part").count().groupBy("text", "copy").agg(
            F.sum("count").alias("rows"), F.max("count").alias("largest")
        ).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert largest and all(r["rows"] == 2000 for r in largest)
    assert any(r["largest"] < 2000 for r in largest)
