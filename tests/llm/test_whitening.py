"""Whitening against plain eigenvectors, and the counts and projections below it."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import catalog, contours, whitening


def spectra():
    random = np.random.RandomState(0)
    for size in (1, 5, 64):
        a = random.normal(size=(300, size)) * np.exp(random.normal(size=size))
        yield a.T @ a / 300
    yield np.diag([3.0, 3, 3, 2, 2, 1, 1, 1])
    yield 7 * np.eye(30)
    low = random.normal(size=(300, 3)) @ random.normal(size=(3, 40))
    yield low.T @ low / 300


@pytest.mark.parametrize("matrix", list(spectra()), ids=lambda m: f"{len(m)}")
def test_leading_pairs(matrix):
    whole = np.linalg.eigvalsh(matrix)[::-1]
    values, axes = contours.leading(matrix, 8)
    assert values == pytest.approx(whole[:8], abs=1e-12 * whole[0])
    assert axes.T @ axes == pytest.approx(np.eye(axes.shape[1]), abs=1e-12)
    assert matrix @ axes == pytest.approx(axes * values, abs=1e-11 * whole[0])
    for shift in (0.03 * whole[0], 0.4 * whole[0], 0.95 * whole[0], 2 * whole[0]):
        assert contours.count_above(matrix, shift) == (whole > shift).sum()


def test_query_equals_brute_force(spark, data):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    good = {i: v for i, v in vectors.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    x = {i: np.array([math.floor(1024 * c) + 100000 for c in v]) for i, v in good.items()}
    whole = np.stack(list(x.values()))
    n, sums = len(whole), whole.sum(0)
    centred = (n * whole - sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    found = catalog.QUERIES["op12_whitened_embeddings"](spark, data).collect()
    assert len(found) == 8 * n and {r["identity_error"] for r in found} == {found[0]["identity_error"]}
    assert 0 <= found[0]["identity_error"] <= 1e-9
    signs = {}
    for r in found:
        i, k = r["vec_id"], r["component"] - 1
        expected = (x[i] - sums / n) @ axes[:, k] / math.sqrt(values[k])
        if abs(expected) > 1e-3:
            assert signs.setdefault(k, np.sign(expected * r["whitened"])) == np.sign(expected * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(expected), abs=1e-8)
        assert (r["n"], r["deviation"]) == (n, int(((n * x[i] - sums) ** 2).sum()))
        assert r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-9)


def test_unusable_rows_and_extra_columns(spark):
    good = [(i, [float(i % 7), float(i % 3), 1.0], "w") for i in range(1, 40)]
    bad = [(50, None, ""), (51, [None, 1.0, 2.0], ""), (52, [float("nan")] * 3, ""), (53, [math.inf, 0.0, 0.0], None), (54, [1.0], ""), (55, [], ""), (56, [1e300, 0.0, 0.0], "")]
    docs = spark.createDataFrame([*good, *bad, good[0], (None, good[4][1], "")], "vec_id long, embedding array<double>, whitened string")
    found = whitening.whitened(docs).collect()
    assert {r["vec_id"] for r in found} == {*range(1, 40), None}
    assert {r["component"] for r in found} == {1, 2} and {r["n"] for r in found} == {41}  # the third dimension has no variance
    per_row = [(r["vec_id"], r["component"]) for r in found]
    assert per_row.count((1, 1)) == 2 and found[0]["identity_error"] < 1e-9


def test_ties_single_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect() == []
    corners = [(i, [float(i & 1), float(i >> 1)]) for i in range(4)]
    found = whitening.whitened(spark.createDataFrame(corners, schema)).collect()
    assert len(found) == 8 and all(r["explained"] == pytest.approx(0.5) for r in found)
    assert found[0]["identity_error"] < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 3)), float(i)]) for i in range(30)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where(F.col("component") == 1).collect()
    x = np.array([[1024 * 2**40 * (i % 3) + 100000, 1024 * i + 100000] for i in range(30)], object)
    exact = ((30 * x - x.sum(0)) ** 2).sum(1)
    assert [r["deviation"] for r in sorted(found, key=lambda r: r["vec_id"])] == [v if v < 2**63 else None for v in exact]
