"""Whitening of embeddings: projections on the leading components of their covariance, scaled to variance one.

Three passes over the vectors. Tasks add up counts and sums, then centred products, then the
covariance of the whitened values; Spark adds the parts, which hold one number per pair of
dimensions at most, and only those sums reach the driver. The eigenvectors come from
``contours.leading``.

Every entry c becomes the long ``floor(1024 c) + 100000``, so counts, sums and ``deviation`` are exact.
Vectors that are null, or hold null or non-finite entries, take no part, and neither do empty
ones, those of another length than most (of equally frequent lengths the smaller counts), nor those with
an entry beyond ``LARGEST``, which no long holds. Repeated rows count each. A null id is kept. A component without variance has
no scale: its rows are left out. A ``deviation`` beyond a long is null. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.contours import leading

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Largest size of an entry, scaled, that takes part.
LARGEST = float(1 << 52)
#: Eigenvalues up to this share of the trace are rounding of zero.
NO_VARIANCE = 1e-13
#: Rows held as a matrix at once.
STEP = 8_192

_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitener:
    """What the passes learned: ``axes`` has one unit vector per column, ``values`` falling eigenvalues."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: longs where they fit, Python integers otherwise."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most <= _LONG else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def squares(self, away: np.ndarray) -> list[int | None]:
        """Sum of squares per row, exact, null where no long holds it."""
        bound = float(np.abs(away).max(initial=0)) ** 2 * away.shape[1]
        if away.dtype == np.int64 and bound < _LONG:
            return (away * away).sum(1).tolist()
        exact = (away.astype(object) ** 2).sum(1)
        return [int(v) if v <= _LONG else None for v in exact]

    def __call__(self, away: np.ndarray) -> np.ndarray:
        return (away.astype(float) / self.n) @ self.axes / np.sqrt(self.values)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) with x as longs; the dimension is not yet the same."""
    given = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    fits = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST / SCALE))
    good = given.where("v is not null and size(v) > 0").where(fits)
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(OFFSET)).alias("x"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows as a matrix of longs) of a batch whose vectors have equal lengths."""
    column = batch.column("x")
    for at in range(0, batch.num_rows, STEP):
        part = column.slice(at, STEP)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of the most frequent length's vectors, and their exact sum per dimension."""

    def add(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, list[int]] = {}
        for batch in source:
            lengths = np.diff(batch.column("x").offsets.to_numpy())
            for size in np.unique(lengths).tolist():
                same = batch.filter(pa.array(lengths == size))
                for _, x in matrices(same):
                    # Halves of 26 bits: no partial sum leaves a long.
                    high, low = (x >> 26).sum(0).tolist(), (x & ((1 << 26) - 1)).sum(0).tolist()
                    own = [(h << 26) + w for h, w in zip(high, low, strict=True)]
                    totals[size] = [a + b for a, b in zip(totals.get(size, [0] * size), own, strict=True)]
                    counts[size] = counts.get(size, 0) + len(x)
        for size, total in totals.items():
            values = [str(v) for v in (counts[size], *total)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * (size + 1), pa.int32()), pa.array(range(-1, size), pa.int32()), pa.array(values)], names=["size", "dim", "value"]
            )

    parts = rows.select("x").mapInArrow(add, "size int, dim int, value string")
    summed = parts.groupBy("size", "dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    usual = summed.where("dim = -1").orderBy(F.desc("value"), "size").first()
    if usual is None:
        return 0, []
    found = {r["dim"]: int(r["value"]) for r in summed.where(F.col("size") == usual["size"]).collect()}
    return found[-1], [found[d] for d in range(usual["size"])]


def _products(rows: DataFrame, size: int, make) -> np.ndarray:
    """Sum over all rows of the outer product of ``make(x)``, a vector of ``size`` doubles, with itself."""

    def add(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in source:
            for _, x in matrices(batch):
                y = make(x)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "parts"])

    parts = rows.select("x").mapInArrow(add, "i int, parts array<double>")
    cells = parts.select("i", F.posexplode("parts").alias("j", "part")).groupBy("i", "j").agg(F.sum("part").alias("value"))
    lines = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("line"))
    found = np.zeros((size, size))
    for row in lines.collect():
        found[row["i"]] = [cell["value"] for cell in row["line"]]
    return found


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitener, DataFrame]:
    """The whitener of ``usable`` rows, and those of them that have the usual dimension."""
    n, sums = _sums(rows)
    same = rows.where(F.size("x") == len(sums))
    if not n:
        return Whitener(0, [], 0.0, np.zeros(0), np.zeros((0, 0))), same
    plain = Whitener(n, sums, 0.0, np.ones(len(sums)), np.eye(len(sums)))
    # Deviations are exact integers; dividing them first keeps products of centred values.
    covariance = _products(same, len(sums), lambda x: plain.deviations(x).astype(float) / n) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading(covariance, components)
    trace = float(np.trace(covariance))
    real = values > NO_VARIANCE * max(trace, 1e-300)
    return Whitener(n, sums, trace, values[real], axes[:, real]), same


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model, rows = fitted(usable(vectors), components)
    count = len(model.values)
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    spread = _products(rows, count + 1, lambda x: np.column_stack((model(model.deviations(x)), np.ones(len(x)))))
    mean = spread[count, :count] / model.n
    error = float(np.abs(spread[:count, :count] / model.n - np.outer(mean, mean) - np.eye(count)).max())

    def project(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at, x in matrices(batch):
                away = model.deviations(x)
                ids = batch.column("vec_id").slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), count)))
                squares = np.repeat(np.array(model.squares(away), object), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * count, model.n)),
                        pa.array(squares.tolist(), pa.int64()),
                        pa.array(model(away).ravel()),
                        pa.array(np.tile(model.values / model.trace, len(x))),
                        pa.array(np.full(len(x) * count, error)),
                    ],
                    names=[part.split()[0] for part in schema.split(", ")],
                )

    return rows.mapInArrow(project, schema)
