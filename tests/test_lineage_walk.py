"""Bit-parallel lineage walks against plain searches, and the plan of a level."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest

from shelfwatch.operators import lineage


def searched(pairs, origins, direction):
    steps = defaultdict(set)
    for child, parent in pairs:
        a, b = (child, parent) if direction == "upstream" else (parent, child)
        steps[a].add(b)
    found = {}
    for origin in origins:
        near, queue = {origin: 0}, deque([origin])
        while queue:
            node = queue.popleft()
            for other in steps[node] - near.keys():
                near[other] = near[node] + 1
                queue.append(other)
        found |= {(direction, origin, node): d for node, d in near.items()}
    return found


@pytest.mark.parametrize("hot_degree", [100_000, 3])
def test_many_origins_on_a_cyclic_graph(spark, monkeypatch, hot_degree):
    """More than 64 origins, cycles, diamonds, a node of most edges, walked by its bucket or apart from it."""
    monkeypatch.setattr(lineage, "HOT_DEGREE", hot_degree)
    draw = random.Random(4)
    pairs = {(f"n{draw.randrange(200)}", f"n{draw.randrange(200)}") for _ in range(260)} | {(f"n{i}", "n0") for i in range(150)}
    origins = [f"n{i}" for i in range(0, 200, 2)]
    edges = spark.createDataFrame(sorted(pairs), "child string, parent string")
    start = spark.createDataFrame([(o, o) for o in origins], "origin string, unique_id string")
    reached = lineage.walk(spark, edges, start, lineage.DIRECTIONS).collect()
    found = {(r["direction"], r["origin"], r["unique_id"]): r["distance"] for r in reached}
    assert len(reached) == len(found)
    assert found == searched(pairs, origins, "upstream") | searched(pairs, origins, "downstream")
    near = lineage.walk(spark, edges, start, ["upstream"], max_depth=5).collect()
    assert {(r["direction"], r["origin"], r["unique_id"]): r["distance"] for r in near} == {
        k: d for k, d in searched(pairs, origins, "upstream").items() if d <= 5
    }


def test_a_level_shuffles_no_steps_and_no_visited_nodes(spark):
    """Only what a level reaches moves: no exchange stands above a scan of a bucketed table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # as the walk does
    try:
        for name, schema in (("walk_steps", "place string, next_place string"), ("walk_seen", "place string, block long, mask long, distance int")):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark.createDataFrame([], schema).write.bucketBy(4, "place").saveAsTable(name)
        plan = lineage.next_levels(spark, "walk_seen", "walk_steps", 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for name in ("walk_steps", "walk_seen"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-|")) for line in lines]
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert sum("walk_steps" in lines[i] for i in scans) == 1 and sum("walk_seen" in lines[i] for i in scans) == 2
    for i in scans:
        assert "Bucketed: true" in lines[i]
        above, at = [], depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                above.append(lines[j])
                at = depth[j]
        first = next(line for line in above if "Join" in line)
        assert not any("Exchange" in line for line in above[: above.index(first)])
