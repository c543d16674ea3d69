from fractions import Fraction

import numpy as np
import pytest

from relrank.llm import whitening
from relrank.llm.queries import QUERIES


def brute(rows):
    """n, {id: (deviation, centred)} and the covariance in exact fractions, by definition."""
    kept = [(i, [int(np.floor(64.0 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    total = [sum(column) for column in zip(*fit)]
    deviation = [(i, sum((n * a - t) ** 2 for a, t in zip(x, total)), [float(Fraction(n * a - t, n)) for a, t in zip(x, total)]) for i, x in kept]
    centred = np.array([[float(Fraction(n * a - t, n)) for a, t in zip(x, total)] for x in fit])
    return n, deviation, centred.T @ centred / n


def check(df, rows, components=16):
    n, want, covariance = brute(rows)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for r in df.collect():
        found.setdefault(r.component, []).append(r)
    assert sorted(found) == list(range(1, min(components, len(values)) + 1))
    for k, own in found.items():
        assert sorted((r.vec_id, r.deviation) for r in own) == sorted((i, d) for i, d, _ in want)
        assert {r.n for r in own} == {n}
        assert all(abs(r.explained - values[k - 1] / values.sum()) <= 1e-10 * r.explained for r in own)
        assert all(r.identity_error < 1e-9 for r in own)
        by_key = {}
        for i, d, c in want:
            by_key.setdefault((i, d), []).append(float(np.dot(c, vectors[:, k - 1]) / np.sqrt(values[k - 1])))
        mine = {}
        for r in own:
            mine.setdefault((r.vec_id, r.deviation), []).append(r.whitened)
        largest = max(by_key, key=lambda key: abs(by_key[key][0]))
        sign = np.sign(by_key[largest][0] * mine[largest][0])
        for key, values_ in by_key.items():
            assert np.allclose(sorted(values_), sorted(sign * v for v in mine[key]), rtol=1e-7, atol=1e-7)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(QUERIES["op13_embedding_whitening"](spark, "/root/testdata/sf0.01"), rows)


def test_cases(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(c) for c in draw.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    rows += [(7, rows[3][1]), (100, rows[3][1]), (100, rows[3][1]), (101, None), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5)]
    rows += [(104, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], "vec_id long, embedding array<float>, x string, n string, component string")
    check(whitening.whiten(df), rows)
    other = spark.createDataFrame([(300, [1.0, 2.0]), (301, []), (None, rows[0][1])], "vec_id long, embedding array<float>")
    found = whitening.whiten(df.unionByName(other, True))
    assert {r.vec_id for r in found.collect()} == {i for i, v in rows if i not in (101, 102, 103, 104)} | {None}
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(other.where("vec_id = 301")).count() == 0


def test_without_variance(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(5)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 15 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in found)
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    found = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in found)


def test_huge_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.5, 2.0])]
    found = {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(found) == 6 and found[1, 1].deviation is None and found[1, 1].n == 3


@pytest.mark.parametrize("gap", [1.0, 1e-4, 1e-9, 1e-13, 0.0])
def test_refinement(gap):
    """Clusters of close and equal eigenvalues, and many sizes at once."""
    size = 40
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(size, size)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to the last digit of extended precision
        q = q @ (1.5 * np.eye(size, dtype=np.longdouble) - 0.5 * q.T @ q)
    values = np.array([1000.0, 500.0, *(100 + gap * np.arange(5)), *(20 + 3 * gap * np.arange(3)), *np.geomspace(10, 1e-6, size - 10)], np.longdouble)
    matrix = (q * values) @ q.T
    matrix = ((matrix + matrix.T) / 2).astype(np.float64)
    found, vectors = whitening.refine(matrix)
    wide = vectors.astype(np.longdouble)
    assert np.allclose(found, np.sort(values.astype(np.float64))[::-1], rtol=1e-13, atol=1e-12)
    assert np.abs(wide.T @ wide - np.eye(size)).max() < 1e-15
    assert np.abs(matrix.astype(np.longdouble) @ wide - wide * found).max() < 4e-13  # eps * |A|
    plain = np.linalg.eigh(matrix.astype(np.float32))[1]
    assert np.abs(matrix @ plain - plain * np.diag(plain.T @ matrix @ plain)).max() > 1e-6  # where it started
