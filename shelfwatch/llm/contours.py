"""Leading eigenpairs of a symmetric matrix by contour integration, with counts that none is missed.

The matrix has one row per dimension of the vectors, whatever the number of vectors. The real axis is
cut into intervals at shifts that lie in gaps of the spectrum; how many eigenvalues are above a shift
is the number of positive pivots of a symmetric elimination (Sylvester's law of inertia). For each
interval a random block is projected onto the eigenvectors inside by quadrature of
``(zI - V)^-1 Y`` along a circle around the interval, and Rayleigh-Ritz extracts the pairs; the
result is the next block, until residuals are at rounding level. The number of pairs found inside must
equal the difference of the counts, otherwise the block grows.
"""

from __future__ import annotations

import numpy as np

#: Gauss-Legendre nodes on the half circle; the other half is its mirror image.
NODES = 8
#: Eigenvalues that one interval should hold at most.
CLUSTER = 12
ROUNDS = 24
#: Residual, relative to the matrix, at which a pair counts as found.
RESIDUAL = 2e-14
_PIVOT = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of an elimination with 1x1 and 2x2 pivots."""
    rest = np.array(matrix, float)
    rest[np.diag_indices_from(rest)] -= shift
    above = 0
    while len(rest):
        size = np.abs(rest)
        k = int(size.diagonal().argmax())
        i, j = divmod(int(size.argmax()), len(rest))
        if size[i, j] == 0:
            break
        if size[k, k] >= _PIVOT * size[i, j]:
            chosen, above = [k], above + int(rest[k, k] > 0)
        else:  # an indefinite pair: one positive, one negative
            chosen, above = [i, j], above + 1
        others = np.delete(np.arange(len(rest)), chosen)
        edge = rest[np.ix_(others, chosen)]
        rest = rest[np.ix_(others, others)] - edge @ np.linalg.solve(rest[np.ix_(chosen, chosen)], edge.T)
        rest = (rest + rest.T) / 2
    return above


def _cuts(matrix: np.ndarray, wanted: int, top: float, tiny: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside) from the top down that hold at least ``wanted``."""
    found: list[tuple[float, float, int]] = []

    def split(low: float, high: float, below: int, above: int) -> None:
        """``below`` and ``above`` eigenvalues are above ``low`` and ``high``."""
        if below == above or above >= wanted:
            return
        width = high - low
        if (below - above <= CLUSTER and below <= wanted + CLUSTER) or width <= tiny:
            found.append((low, high, below - above))
            return
        # A shift too near an eigenvalue moves on: both sides of the gap must count alike.
        for share in (0.5, 0.46, 0.54, 0.42, 0.58, 0.38, 0.62):
            middle = low + share * width
            here = count_above(matrix, middle)
            if here == count_above(matrix, middle - 1e-4 * width) == count_above(matrix, middle + 1e-4 * width):
                break
        split(middle, high, here, above)
        split(low, middle, below, here)

    split(-1e-3 * top, top, len(matrix), 0)
    return found


def _inside(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` and their unit vectors."""
    size, norm = len(matrix), np.abs(matrix).sum(1).max()
    middle, radius = (low + high) / 2, (high - low) / 2
    at, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - at)
    points, random = middle + radius * np.exp(1j * angles), np.random.RandomState(7)
    width = min(size, max(count + 4, count * 3 // 2))
    while True:
        block = random.normal(size=(size, width))
        for _ in range(ROUNDS):
            projected = np.zeros((size, width))
            for z, angle, weight in zip(points, angles, weights, strict=True):
                solved = np.linalg.solve(z * np.eye(size) - matrix, block.astype(complex))
                projected += weight / 2 * (radius * np.exp(1j * angle) * solved).real
            basis, strength, _ = np.linalg.svd(projected, full_matrices=False)
            basis = basis[:, strength > strength[0] * 1e-14] if strength[0] > 0 else basis
            values, small = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ small
            held = (values > low) & (values < high)
            residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
            good = held & (residual <= RESIDUAL * norm * size**0.5)
            if good.sum() == count:
                return values[good], vectors[:, good]
            block = vectors if vectors.shape[1] == width else np.column_stack((vectors, random.normal(size=(size, width - vectors.shape[1]))))
        if width == size:
            raise ArithmeticError(f"{good.sum()} of {count} eigenvalues between {low} and {high} converged")
        width = min(size, 2 * width)


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite matrix, falling, and unit vectors as columns."""
    size = len(matrix)
    wanted = min(wanted, size)
    norm = np.abs(matrix).sum(1).max() if size else 0.0
    if not wanted or norm == 0:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    scaled = matrix / norm
    pairs = [_inside(scaled, *interval) for interval in _cuts(scaled, wanted, 1.001, 1e-6)]
    # Pairs of neighbouring intervals are orthogonal already; one more Rayleigh-Ritz step over all removes rounding.
    basis, _ = np.linalg.qr(np.column_stack([vectors for _, vectors in pairs]))
    values, small = np.linalg.eigh(basis.T @ scaled @ basis)
    order = np.argsort(-values)[:wanted]
    return values[order] * norm, (basis @ small)[:, order]
