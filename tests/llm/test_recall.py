"""Recall of the neighbour search where inner products follow the norms, over several shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfwatch.llm import nearest


def test_recall_with_log_normal_norms_over_shards(spark):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(20_000, 48))
    points *= np.exp(rng.normal(size=(len(points), 1)) * 0.5) / np.linalg.norm(points, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id long, embedding array<double>")
    found: dict[int, set[int]] = {}
    for row in nearest.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = 0
    for query in range(0, len(points), 20):
        scores = points @ points[query]
        scores[query] = -np.inf
        hits += len(found[query] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(found) and len(found) == 1000
