"""Lineage over node and edge tables.

Closures grow level by level. All origins of a walk grow together: 64 of them share
one ``bigint`` per node, a bit each, so a step of all of them is one ``bit_or``. Steps
and visited nodes are tables bucketed by node: a level reads its own rows and the
buckets, shuffles nothing but the nodes it reaches, and is written before the
next one starts. A lost executor costs one level at most, and the stop test is the
row count taken while writing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfwatch.functions.skew import MAX_KEYS, SKETCH_SIZE, union_all
from shelfwatch.session import scratch_path

# The two directions and the default depth of the upstream walk.
DIRECTIONS = ("upstream", "downstream")
DEFAULT_DEPTH = 3
#: Steps that one job walks; its exchanges hold reached nodes only, so more steps cost stages, not rounds.
STEPS = 4
#: Steps from one node above which they may be joined apart from its bucket.
HOT_DEGREE = 100_000

# Schema of the manifest artefact.
NODE = (
    "struct<unique_id: string, resource_type: string, name: string, "
    "depends_on: struct<nodes: array<string>>>"
)
MANIFEST = f"nodes map<string, {NODE}>, sources map<string, {NODE}>"


def manifest_nodes(manifests: DataFrame) -> DataFrame:
    """Node table of manifest documents: models and tests, plus sources."""
    both = F.map_concat(
        F.coalesce("nodes", F.create_map().cast(f"map<string, {NODE}>")),
        F.coalesce("sources", F.create_map().cast(f"map<string, {NODE}>")),
    )
    return manifests.select(F.explode(both).alias("unique_id", "node")).select(
        "unique_id",
        F.col("node.resource_type").alias("resource_type"),
        F.col("node.name").alias("name"),
        F.col("node.depends_on.nodes").alias("parents"),
    )


def edges(nodes: DataFrame, known_only: bool = True) -> DataFrame:
    """(child, parent) pairs whose parent is a known node, or all of them."""
    pairs = nodes.select(F.col("unique_id").alias("child"), F.explode("parents").alias("parent")).distinct()
    if not known_only:
        return pairs
    # A plain scan on the right keeps both sides bare shuffles, so adaptive
    # execution can split a parent that has very many children.
    known = nodes.select(F.col("unique_id").alias("parent"))
    return pairs.join(known, "parent", "left_semi").select("child", "parent")


def unknown_ids(failed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Failed ids that are not nodes."""
    named = failed.select("unique_id").distinct()
    return named.join(nodes.select("unique_id"), "unique_id", "left_anti")


def require_known(failed: DataFrame, nodes: DataFrame) -> None:
    """Refuse failed ids that are not nodes; names the first few in the error."""
    missing = [row["unique_id"] for row in unknown_ids(failed, nodes).orderBy("unique_id").take(10)]
    if missing:
        raise ValueError(f"Failed nodes not in the manifest: {', '.join(missing)}")


def _save(df: DataFrame, table: str, path: str, *metrics: Column) -> dict[str, Any]:
    """Append rows to a table bucketed by ``place``; returns metrics taken during the write."""
    seen = Observation(f"{table}_{uuid.uuid4().hex}")
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.write.mode("append").bucketBy(buckets, "place").option("path", path).saveAsTable(table)
    return seen.get


def numbered_origins(start: DataFrame, path: str) -> DataFrame:
    """(origin, block, bit) of every origin, written: 64 origins to a block, apart from the last of a task."""
    number = F.monotonically_increasing_id()
    numbered = start.select("origin").distinct().select("origin", number.alias("number"))
    blocks = numbered.select("origin", F.shiftright("number", 6).alias("block"), (F.col("number") % 64).cast("int").alias("bit"))
    blocks.write.parquet(path)
    return start.sparkSession.read.schema(blocks.schema).parquet(path)


def next_levels(spark: SparkSession, seen: str, steps: str, depth: int, count: int = 1, hot: Sequence[str] = ()) -> DataFrame:
    """(place, block, mask, distance): origins that reach a place for the first time after ``depth`` + 1 to ``count`` steps.

    Table ``seen`` holds what was reached up to ``depth``. Only the first step starts from its newest rows alone;
    the others may walk through visited places, which the last line takes out. Rows of the ``hot`` places, a
    bounded list, are joined apart from their bucket, which all other buckets would have to wait for.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [f"l0 AS (SELECT place, block, mask FROM {seen} WHERE distance = {depth})"]
    for i in range(1, count + 1):
        met = f"SELECT s.next_place, l.block, l.mask FROM l{i - 1} l JOIN {steps} s ON l.place = s.place"
        if hot:
            apart = f"(SELECT /*+ REPARTITION(place, next_place) */ * FROM {steps} WHERE array_contains(:hot, place))"
            met = f"{met} WHERE NOT array_contains(:hot, l.place) UNION ALL SELECT s.next_place, l.block, l.mask FROM {apart} s JOIN l{i - 1} l ON l.place = s.place"
        parts.append(f"l{i} AS (SELECT next_place AS place, block, bit_or(mask) AS mask FROM ({met}) GROUP BY next_place, block)")
    every = " UNION ALL ".join(f"SELECT place, block, mask, {i} AS number FROM l{i}" for i in range(1, count + 1))
    masks = ", ".join(f"bit_or(if(number = {i}, mask, 0L)) AS m{i}" for i in range(1, count + 1))
    # Dealt as the buckets are, so the visited side of the join stays where it is.
    parts.append(f"reached AS (SELECT /*+ REPARTITION({buckets}, place) */ * FROM (SELECT place, block, {masks} FROM ({every}) GROUP BY place, block))")
    parts.append(f"known AS (SELECT place, block, bit_or(mask) AS m0 FROM {seen} GROUP BY place, block)")
    fresh = ", ".join(
        f"named_struct('mask', m{i} & ~({' | '.join(['coalesce(m0, 0L)', *(f'm{j}' for j in range(1, i))])}), 'distance', {depth + i})" for i in range(1, count + 1)
    )
    found = f"SELECT place, block, inline(array({fresh})) FROM reached LEFT JOIN known USING (place, block)"
    return spark.sql(f"WITH {', '.join(parts)} SELECT place, block, mask, distance FROM ({found}) WHERE mask <> 0", {"hot": list(hot)} if hot else {})


def walk(
    spark: SparkSession,
    edge_table: DataFrame,
    start: DataFrame,
    directions: Sequence[str],
    max_depth: int | None = None,
) -> DataFrame:
    """Nodes reached from each origin with their shortest distance.

    ``start`` has (origin, unique_id) at distance 0; the result adds ``direction``
    and ``distance`` and includes the start rows. A node is entered once per
    direction and origin, at the level that reaches it first, so cycles end and
    diamonds do not multiply. Both directions grow in the same rounds.
    """
    if not directions or set(directions) - set(DIRECTIONS):
        raise ValueError("direction is upstream or downstream")
    sides = {"upstream": ("child", "parent"), "downstream": ("parent", "child")}
    base, tag = scratch_path(spark, "lineage"), uuid.uuid4().hex
    steps_table, seen_table = f"lineage_steps_{tag}", f"lineage_seen_{tag}"

    def place(direction: str, column: str) -> Column:
        return F.concat(F.lit(f"{direction[0]}:"), F.col(column))

    steps = union_all([edge_table.select(place(d, sides[d][0]).alias("place"), place(d, sides[d][1]).alias("next_place")) for d in directions])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = F.expr(f"approx_top_k(place, {MAX_KEYS}, {SKETCH_SIZE})").alias("top")
    held = _save(steps.repartition(buckets, "place"), steps_table, f"{base}/steps", top)
    hot = [e["item"] for e in (held["top"] or []) if e["count"] > max(HOT_DEGREE, held["rows"] / MAX_KEYS)]
    origins = numbered_origins(start, f"{base}/origins")
    masks = start.join(origins, "origin").groupBy("unique_id", "block").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    first = union_all([masks.select(place(d, "unique_id").alias("place"), "block", "mask", F.lit(0).alias("distance")) for d in directions])
    # Lets the join on (place, block) keep both sides dealt by place alone, as the buckets are.
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        depth, rows = 0, _save(first.repartition(buckets, "place"), seen_table, f"{base}/seen")["rows"]
        while rows and (max_depth is None or depth < max_depth):
            count = STEPS if max_depth is None else min(STEPS, max_depth - depth)
            levels = next_levels(spark, seen_table, steps_table, depth, count, hot)
            depth += count
            rows = _save(levels, seen_table, f"{base}/seen", F.count_if(F.col("distance") == depth).alias("last"))["last"]
    finally:
        spark.conf.set(setting, before)
        # The files stay for the result below; only the names go.
        spark.sql(f"DROP TABLE IF EXISTS {seen_table}")
        spark.sql(f"DROP TABLE IF EXISTS {steps_table}")
    seen = spark.read.schema("place string, block bigint, mask bigint, distance int").parquet(f"{base}/seen")
    return (
        seen.select("place", "block", "distance", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(mask, b) & 1) = 1)")).alias("bit"))
        .join(origins, ["block", "bit"])
        .select(
            F.when(F.col("place").startswith("u"), "upstream").otherwise("downstream").alias("direction"),
            "origin",
            F.substring("place", 3, 1 << 30).alias("unique_id"),
            "distance",
        )
    )


def _reached(
    spark: SparkSession, edge_table: DataFrame, failed: DataFrame, directions: Sequence[str]
) -> DataFrame:
    """Nodes around the failed set, the set itself excluded.

    The set is walked as one origin, so shared ancestors are visited once.
    """
    start = failed.select(F.lit(0).alias("origin"), "unique_id")
    return walk(spark, edge_table, start, directions).where(F.col("distance") > 0)


def closure(
    spark: SparkSession, edge_table: DataFrame, failed: DataFrame, direction: str, nodes: DataFrame
) -> DataFrame:
    """All nodes up- or downstream of the failed set, with their distance."""
    require_known(failed, nodes)
    return _reached(spark, edge_table, failed, [direction]).select("unique_id", "distance")


def distances(
    spark: SparkSession, edge_table: DataFrame, failed: DataFrame, nodes: DataFrame, max_depth: int | None = None
) -> DataFrame:
    """Signed distance of every model to every failure: upstream negative.

    The result has a row per failure and model in reach; ``max_depth`` bounds the reach.
    """
    require_known(failed, nodes)
    start = failed.select(F.col("unique_id").alias("origin"), "unique_id")
    reached = walk(spark, edge_table, start, DIRECTIONS, max_depth).where(F.col("distance") > 0)
    models = nodes.where(F.col("resource_type") == "model").select("unique_id")
    signed = F.when(F.col("direction") == "upstream", -F.col("distance")).otherwise(F.col("distance"))
    return reached.join(models, "unique_id", "left_semi").select(
        F.col("origin").alias("failed_id"), "unique_id", signed.alias("lineage_level")
    )


def summary(
    spark: SparkSession, edge_table: DataFrame, failed: DataFrame, nodes: DataFrame
) -> DataFrame:
    """Number of models and of all nodes per part of the lineage.

    The lists behind the counts are the closure tables themselves; as one list
    in one row they would not scale.
    """
    require_known(failed, nodes)
    around = _reached(spark, edge_table, failed, DIRECTIONS).select(
        "unique_id", F.col("direction").alias("part")
    )
    parts = failed.select("unique_id").distinct().withColumn("part", F.lit("failed")).unionByName(around)
    return (
        parts.join(nodes.select("unique_id", "resource_type"), "unique_id")
        .groupBy("part")
        .agg(
            F.count_if(F.col("resource_type") == "model").alias("model_count"),
            F.count(F.lit(1)).alias("node_count"),
        )
    )


def selected_nodes(
    spark: SparkSession, edge_table: DataFrame, failed: DataFrame, nodes: DataFrame
) -> DataFrame:
    """The rows of ``nodes`` that failed or lie up- or downstream of a failure, with all their fields."""
    require_known(failed, nodes)
    around = _reached(spark, edge_table, failed, DIRECTIONS).select("unique_id")
    return nodes.join(failed.select("unique_id").unionByName(around), "unique_id", "left_semi")


def upstream_within(
    spark: SparkSession,
    edge_table: DataFrame,
    roots: DataFrame,
    nodes: DataFrame,
    depth: int = DEFAULT_DEPTH,
    direction: str = "upstream",
) -> DataFrame:
    """Roots and their ancestors up to a depth, with the shortest level.

    Edges to unknown parents (see ``edges``) end in rows without a name. Any other
    direction than upstream returns only the roots.
    """
    require_known(roots, nodes)
    start = roots.select(F.col("unique_id").alias("origin"), "unique_id").distinct()
    if direction == "upstream":
        reached = walk(spark, edge_table, start, ["upstream"], depth)
    else:
        reached = start.withColumn("distance", F.lit(0))
    names = nodes.select("unique_id", "name")
    return reached.join(names, "unique_id", "left").select(
        F.col("origin").alias("root_id"), "unique_id", "name", F.col("distance").alias("level")
    )


def tests_of(nodes: DataFrame, models: DataFrame) -> DataFrame:
    """Tests that depend on the given models."""
    tests = nodes.where(F.col("resource_type") == "test").select(
        F.col("unique_id").alias("test_id"), "name", F.explode("parents").alias("model_id")
    )
    wanted = models.select(F.col("unique_id").alias("model_id"))
    return tests.join(wanted, "model_id", "left_semi").select("model_id", "test_id", "name").distinct()
