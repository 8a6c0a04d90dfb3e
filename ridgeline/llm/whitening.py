"""Whitening of vectors: centred, turned to the leading components of their
covariance, each scaled to unit variance.

The covariance is summed in tasks over centred vectors and added up cell by cell
in a shuffle; its leading eigenvectors come from Householder
tridiagonalisation, bisection on Sturm counts and inverse iteration
(``spectral``), on a matrix whose size is the vectors' dimension; the projection
is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spectral, storage
from .batches import map_batches

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Whole numbers below this stay exact in sums of two of them.
SAFE = 2**61
#: Rows of a block inside a task.
BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """The ``components`` leading ones; entries become floor(``scale`` * c) +
    ``offset``.  Entries of ``most`` or more in size count as not finite, as
    their multiples are not whole numbers that a double holds.  Components with
    less than ``least`` of the leading one's variance have none that doubles can
    tell from rounding, and are left out."""

    components: int = 16
    scale: int = 64
    offset: int = 1_000_000
    most: float = 2.0**40
    least: float = 1e-12


@dataclass(frozen=True)
class Basis:
    """What a fit found: distinct vectors, their sums, and the projection
    (columns: unit eigenvectors) with eigenvalues and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def shifted(rows: DataFrame, how: Whitening, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vectors are whole and finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < how.most))
    x = F.transform(v, lambda c: F.floor(F.lit(float(how.scale)) * c.cast("double")) + F.lit(how.offset).cast("long"))
    return rows.filter(v.isNotNull()).filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int, fill: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones continued with ``fill``, which is
    all that longer ones hold beyond ``dim``."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.full((len(column), max(dim, int(lengths.max(initial=0)))), fill, dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out[:, :dim]


class _Centre:
    """n * x - S in whole numbers, and (n * x - S) / n."""

    def __init__(self, n: int, sums: tuple[int, ...], fill: int):
        self.n, self.dim, self.fill = n, len(sums), fill
        self.big = max(map(abs, sums), default=0)
        self.sums, self.exact = np.array(sums if self.big < SAFE else [0] * len(sums), dtype=np.int64), np.array(sums, dtype=object)

    def scaled(self, column: pa.Array) -> np.ndarray:
        x = _matrix(column, self.dim, self.fill)
        if self.big < SAFE and int(np.abs(x).max(initial=0)) * self.n < SAFE:
            return x * self.n - self.sums
        return x.astype(object) * self.n - self.exact

    def centred(self, scaled: np.ndarray) -> np.ndarray:
        return scaled.astype(float) / self.n

    def deviation(self, scaled: np.ndarray) -> list[int | None]:
        """Exact sums of squares; null where a long cannot hold one."""
        near = (scaled.astype(float) ** 2).sum(axis=1)
        if scaled.dtype != object and (near < SAFE).all():
            return (scaled * scaled).sum(axis=1).tolist()
        found = (scaled.astype(object) ** 2).sum(axis=1)
        return [int(f) if f < 2**63 else None for f in found]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _sums(fit: DataFrame, how: Whitening) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and their exact sums by dimension; as many rows as
    dimensions come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, seen = 0, [], []
        for batch in _blocks(batches):
            lengths = batch.column("x").value_lengths().to_numpy()
            dim = int(lengths.max(initial=0))
            x = _matrix(batch.column("x"), dim, 0)
            own = x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < SAFE else x.astype(object).sum(axis=0)
            sums += [0] * (dim - len(sums))
            seen += [0] * (dim - len(seen))
            for i in range(dim):
                sums[i] += int(own[i])
                seen[i] += int((lengths > i).sum())
            n += len(x)
        cells = [(-1, Decimal(0), n), *((i, Decimal(sums[i]), seen[i]) for i in range(len(sums)))]
        i, s, m = zip(*cells)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(s, pa.decimal128(38, 0)), pa.array(m, pa.int64())], names=["i", "s", "m"])

    found = map_batches(fit, run, "i int, s decimal(38,0), m long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).collect()
    by = {r["i"]: r for r in found}
    n = by[-1]["m"] if by else 0
    # Vectors that end before a dimension are continued with zeros, which are the offset.
    return n, tuple(int(by[i]["s"]) + (n - by[i]["m"]) * how.offset for i in range(len(by) - 1))


def _products(fit: DataFrame, size: int, rows_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum of w w' over the rows w of all blocks, as a full matrix.  A task
    gives a row for each cell of the upper triangle, and those are added up in a
    shuffle; the driver gets the triangle once."""
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in _blocks(batches):
            w = rows_of(batch)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((size, size))
    for r in map_batches(fit, run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit_basis(vectors: DataFrame, how: Whitening = Whitening()) -> Basis | None:
    """The basis of the distinct vectors of (x), or None without any."""
    # Zeros at the end are cut, as shorter vectors are continued with them.  Copies are
    # dropped within tasks before the shuffle, so a common vector is one row of each.
    end = F.array_max(F.transform("x", lambda c, i: F.when(c != how.offset, i + 1).otherwise(0)))
    short = F.when(F.element_at("x", -1) == how.offset, F.slice("x", 1, F.coalesce(end, F.lit(0)))).otherwise(F.col("x"))
    fit = storage.materialize(vectors.select(F.when(F.size("x") > 0, short).otherwise(F.col("x")).alias("x")).distinct(), "whitening-fit")
    n, sums = _sums(fit, how)
    if not n:
        return None
    dim, centre = len(sums), _Centre(n, sums, how.offset)
    covariance = _products(fit, dim, lambda batch: centre.centred(centre.scaled(batch.column("x")))) / n
    values, vectors_ = spectral.leading(covariance, how.components) if dim else (np.zeros(0), np.zeros((0, 0)))
    some = (values > 0) & (values > how.least * values.max(initial=0.0))
    values, vectors_ = values[some], vectors_[:, some]
    projection = vectors_ / np.sqrt(values)
    k = len(values)

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        # A column of ones gives the sums beside the products.
        w = centre.centred(centre.scaled(batch.column("x"))) @ projection
        return np.concatenate([w, np.ones((len(w), 1))], axis=1)

    error = 0.0
    if k:
        found = _products(fit, k + 1, whitened) / n
        mean = found[:k, k]
        error = float(np.abs(found[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    return Basis(n, sums, values, vectors_, values / np.trace(covariance) if k else values, error)


def project(vectors: DataFrame, basis: Basis, how: Whitening = Whitening()) -> DataFrame:
    """A row for each row of (id, x) and component of the basis."""
    k = len(basis.values)
    shared = vectors.sparkSession.sparkContext.broadcast((basis.projection, basis.n, basis.sums, basis.explained, basis.identity_error))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, n, sums, explained, error = shared.value
        centre = _Centre(n, sums, how.offset)
        for batch in _blocks(batches):
            scaled = centre.scaled(batch.column("x"))
            w, rows = centre.centred(scaled) @ projection, len(scaled)
            at = pa.array(np.repeat(np.arange(rows), k))
            cols = [
                batch.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n)),
                pa.array(centre.deviation(scaled), pa.int64()).take(at), pa.array(w.reshape(-1)), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in OUT.split(", ")])

    return map_batches(vectors, run, OUT)


def whiten(rows: DataFrame, how: Whitening = Whitening(), *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error of every row and leading component.

    Rows whose vector is null, or holds null, non-finite or huge entries
    (``Whitening.most``), take no part.  Rows that repeat a vector count once in
    the fit and are all returned, a null id too.  Shorter vectors are continued
    with zeros.  A component without variance is left out, so equal vectors
    alone, or an empty table, give no rows.  Equal eigenvalues have any
    orthogonal vectors of their space.  A deviation beyond a long is null.
    Other columns are ignored.  The driver holds a matrix of the dimension
    squared.
    """
    vectors = shifted(rows, how, id_col, vector_col)
    basis = fit_basis(vectors, how)
    if basis is None or not len(basis.values):
        return rows.sparkSession.createDataFrame([], OUT)
    return project(vectors, basis, how)
