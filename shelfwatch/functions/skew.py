"""Joins that stay balanced when a few keys hold most rows.

Adaptive execution splits a skewed shuffle partition only where the join sits
directly on both shuffles. When one side is aggregated per key first, the hot
key has to be taken out by hand. :func:`heavy_keys` names such keys (never more
than ``MAX_KEYS``, whatever the table size) and :func:`split_join` joins their
rows against the handful of matching right-hand rows without a shuffle. Which
keys are named changes the distribution of work only, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bound for the list of hot keys, hence for every broadcast made here.
MAX_KEYS = 200
#: Counters kept by the frequent-items sketch.
SKETCH_SIZE = 10_000


def heavy_keys(df: DataFrame, key: str, share: float = 1 / MAX_KEYS) -> list[Any]:
    """Values of ``key`` that hold more than ``share`` of all rows, whatever the number of rows.

    One pass over one column with map-side sketches: no shuffle by key. NULL is
    reported as ``None``. The result has at most ``MAX_KEYS + 1`` entries.
    """
    stats = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(key).isNull()).alias("null_count"),
        F.expr(f"approx_top_k(`{key}`, {MAX_KEYS}, {SKETCH_SIZE})").alias("top"),
    ).first()
    limit = max(1, stats["row_count"] * share)
    keys: list[Any] = [entry["item"] for entry in stats["top"] if entry["count"] > limit]
    if stats["null_count"] > limit:
        keys.append(None)
    return keys


def in_keys(key: str, keys: Sequence[Any]) -> Column:
    """Two-valued membership test that can also match NULL."""
    present = [k for k in keys if k is not None]
    tests = []
    if present:
        tests.append(F.col(key).isin(present) & F.col(key).isNotNull())
    if len(present) < len(keys):
        tests.append(F.col(key).isNull())
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def split_join(
    left: DataFrame, right: DataFrame, key: str, how: str, hot: Sequence[Any] = ()
) -> list[DataFrame]:
    """Join ``left`` to ``right``, which has at most one row per ``key``.

    Returns the branches to union: one shuffled join for ordinary keys and, if
    there are hot keys, one join whose right side is at most ``len(hot)`` rows
    and therefore safe to broadcast. Branches never share a key, so a caller may
    aggregate each one on a superset of ``key`` before the union.
    """
    if not hot:
        return [left.join(right, key, how)]
    if len(hot) > MAX_KEYS + 1:
        raise ValueError("too many hot keys for a broadcast")
    hot_rows = in_keys(key, hot)
    cold = left.where(~hot_rows).join(right.where(~hot_rows), key, how)
    split = left.where(hot_rows).join(F.broadcast(right.where(hot_rows)), key, how)
    return [cold, split]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
