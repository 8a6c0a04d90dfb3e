"""Leading eigenvectors of a small symmetric matrix: Householder
tridiagonalisation, bisection on Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the matrix' norm are one cluster, whose
#: vectors are made orthogonal to one another in each step.
CLUSTER = 1e-3
STEPS = 6


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and the reflectors H of H_m .. H_1 A H_1 .. H_m."""
    a = np.array(matrix, dtype=float)
    size, reflectors = len(a), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        # A column that is done already, but for what rounding left of it.
        if not np.abs(v[1:]).max(initial=0.0) > 0:
            reflectors.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        reflectors.append(v)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(size - 1)]), reflectors


def back(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of the tridiagonal matrix as those of the full one."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def sturm_counts(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each value of ``at``: negative pivots of T - at."""
    square = side * side
    least = np.finfo(float).tiny * max(1.0, square.max(initial=0.0))
    pivot = np.ones_like(at)
    count = np.zeros(len(at), dtype=np.int64)
    for k in range(len(diagonal)):
        pivot = diagonal[k] - at - (square[k - 1] / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, each by bisection."""
    size = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(side)]) + np.concatenate([np.abs(side), [0.0]])
    norm = max((np.abs(diagonal) + reach).max(), np.finfo(float).tiny)
    low, high = np.full(most, (diagonal - reach).min() - EPS * norm), np.full(most, (diagonal + reach).max() + 2 * EPS * norm)
    rank = size - 1 - np.arange(most)  # this many eigenvalues are smaller
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= EPS * np.abs(middle))).all():
            break
        above = sturm_counts(diagonal, side, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, side: np.ndarray, value: float, norm: float):
    """Solve (T - value) z = b by elimination with row exchanges."""
    size = len(diagonal)
    u0, u1, u2 = diagonal - value, np.append(side, 0.0), np.zeros(size)
    factor, swapped = np.zeros(size), np.zeros(size, dtype=bool)
    for k in range(size - 1):
        below = [side[k], u0[k + 1], u1[k + 1]]
        if abs(below[0]) > abs(u0[k]):
            own = [u0[k], u1[k], u2[k]]
            u0[k], u1[k], u2[k] = below
            below, swapped[k] = own, True
        if u0[k] == 0:
            u0[k] = EPS * norm
        factor[k] = below[0] / u0[k]
        u0[k + 1], u1[k + 1] = below[1] - factor[k] * u1[k], below[2] - factor[k] * u2[k]
    least = EPS * norm
    u0 = np.where(np.abs(u0) < least, np.copysign(least, u0), u0)

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k in range(size - 1):
            if swapped[k]:
                b[k], b[k + 1] = b[k + 1], b[k]
            b[k + 1] -= factor[k] * b[k]
        z = np.zeros(size)
        for k in range(size - 1, -1, -1):
            rest = b[k]
            if k + 1 < size:
                rest -= u1[k] * z[k + 1]
            if k + 2 < size:
                rest -= u2[k] * z[k + 2]
            z[k] = rest / u0[k]
        return z / np.abs(z).max()

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit eigenvector (column) for each of the falling ``values``."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(side).max(initial=0.0), np.finfo(float).tiny)
    rng = np.random.default_rng(0)
    out = np.zeros((size, len(values)))
    first, used = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # Equal values are drawn apart by a rounding's breadth, so that their systems differ.
        used = min(value, used - 10 * EPS * norm) if j > first else value
        solve = _solver(diagonal, side, used, norm)
        z = rng.uniform(-1, 1, size)
        for _ in range(STEPS):
            z = solve(z)
            for _ in range(2):
                z -= out[:, first:j] @ (out[:, first:j].T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as
    columns, the entry of largest size positive."""
    most = min(most, len(matrix))
    # A power of two as unit keeps squares of very small or large entries in range.
    top = np.abs(matrix).max(initial=0.0)
    if not top > 0:
        return np.zeros(most), np.eye(len(matrix), most)
    unit = 2.0 ** np.round(np.log2(top))
    diagonal, side, reflectors = tridiagonal(matrix / unit)
    values = leading_values(diagonal, side, most)
    vectors = back(tridiagonal_vectors(diagonal, side, values), reflectors)
    at = np.abs(vectors).argmax(axis=0)
    return values * unit, vectors * np.where(vectors[at, np.arange(most)] < 0, -1.0, 1.0)
