import numpy as np
import pytest
from helpers import SMALL

import __spark_entry__ as entry
from ridgeline.llm import spectral, whitening
from ridgeline.session import table

SCHEMA = "vec_id long, embedding array<double>"


def by_hand(vectors, most=16):
    """n, whole-number deviations, eigenvalues, vectors and trace, by LAPACK."""
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    d = (n * fit - sums) / n
    values, parts = np.linalg.eigh(d.T @ d / n)
    return n, ((n * x - sums) ** 2).sum(axis=1), values[::-1][:most], parts[:, ::-1][:, :most], np.trace(d.T @ d / n), (n * x - sums) / n


def checked(rows, ids, vectors):
    n, deviation, values, parts, trace, d = by_hand(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * len(values) and {r.n for r in rows} == {n}
    w = np.array([[got[i, c + 1].whitened for c in range(len(values))] for i in ids])
    wanted = d @ parts / np.sqrt(values)
    assert np.allclose(np.abs(w), np.abs(wanted), atol=1e-8)
    # Either sign, but the same for all rows.
    assert np.allclose(w * np.sign((w * wanted).sum(axis=0)), wanted, atol=1e-8)
    assert [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert np.allclose([got[ids[0], c + 1].explained for c in range(len(values))], values / trace, rtol=1e-10)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_op11_equals_lapack(spark):
    found = table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()
    checked(entry.queries()["op11_embedding_whitening"](spark, SMALL).collect(), [r.vec_id for r in found], [r.embedding for r in found])


def test_copies_count_once_and_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 20)).round(3).tolist()
    vectors[50:] = [vectors[0]] * 10
    odd = [(100, None), (101, [None] * 20), (102, [float("nan")] * 20), (103, [float("inf")] * 20), (104, [1e300] * 20)]
    rows = spark.createDataFrame([*enumerate(vectors), *odd], SCHEMA).repartition(4).withColumn("x", whitening.F.lit("clash")).withColumn("id", whitening.F.lit(1))
    checked(whitening.whiten(rows).collect(), list(range(60)), vectors)


def test_short_vectors_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0]), (1, [3.0]), (2, []), (2, [3.0, 0.0])], SCHEMA)
    got = whitening.whiten(rows).collect()
    assert len(got) == 10 and {r.n for r in got} == {3} and {r.component for r in got} == {1, 2}
    assert len({r.whitened for r in got if r.component == 1 and r.vec_id == 1}) == 1
    ends = spark.createDataFrame([(k, [float(k), float(k * k), 0.0, 0.0]) for k in range(5)], SCHEMA)
    assert len(whitening.whiten(ends).collect()) == 10


def test_without_variance_there_is_no_component(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 0.0, 2.0 * k]) for k in range(9)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-9


def test_deviations_beyond_machine_words(spark):
    rows = [(k, [float(k % 2) * 2**33, float(k), 0.5]) for k in range(40)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert all(got[k] == (e if e < 2**63 else None) for k, e in enumerate(exact)) and None in got.values()


SPECTRA = {
    "random": np.random.default_rng(1).normal(size=(40, 40)), "identity": np.eye(32), "zero": np.zeros((6, 6)), "one": np.array([[3.0]]), "blocks": np.kron(np.eye(6), np.ones((5, 5))),
    "pairs": np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1), "tiny": np.eye(20) * 1e-200, "close": np.diag([5, 5, 5, 3, 3 + 1e-9, 1, *[1e-3] * 20]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_eigenvectors(name):
    a = SPECTRA[name] + SPECTRA[name].T
    values, vectors = spectral.leading(a, 16)
    norm = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values / norm, np.linalg.eigvalsh(a)[::-1][:16] / norm, atol=1e-13)
    assert np.abs(a @ vectors - vectors * values).max() / norm < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
