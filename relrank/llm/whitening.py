"""Whitening of embeddings: eigenvectors of a distributed covariance, found in single precision and refined.

The covariance is summed over the tasks. Its eigenvectors are first computed in float32; refinement steps of matrix products
in extended precision (after Ogita and Aishima) double the number of right digits each. Vectors of eigenvalues that are too
close for a step to tell apart keep their common span; a small eigenproblem of their own turns them inside it.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relrank.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 1 << 62  # entries beyond count as this
STEPS = 20  # of refinement at most; three or four do unless eigenvalues are close
ROWS = 4096  # vectors multiplied at once


def whole_numbers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors as whole numbers, floor(SCALE * entry) + SHIFT; those that are null or hold null, NaN or
    infinite entries are left out."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + SHIFT)
    return embeddings.where(vector.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _matrices(batches, name: str = "x"):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _matrix(part.column(name))


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums as whole numbers of any size."""
    if np.abs(x).max(initial=0) < 1 << 40:  # ROWS rows: no sum leaves 64 bits
        return [int(v) for v in x.sum(axis=0)]
    return [int(v) for v in x.astype(object).sum(axis=0)]


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of every dimension."""

    def add(batches):
        n, total = 0, None
        for _, x in _matrices(batches):
            own = _exact_sum(x)
            n, total = n + len(x), own if total is None else [a + b for a, b in zip(total, own)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38))],
                ["at", "n", "total"],
            )

    sums = fit.mapInArrow(add, "at int, n long, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = sums.orderBy("at").collect()  # a row per dimension
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [])


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - mean. The whole part of the mean is taken off first, so that nothing is rounded but the result."""
    floor = np.array([t // n for t in total], np.int64)
    rest = np.array([(t % n) / n for t in total])
    return (x - floor).astype(np.float64) - rest


def _gram(fit: DataFrame, rows_of, width: int) -> np.ndarray:
    """The sum of the outer products of the rows that ``rows_of`` makes of each batch of vectors: a matrix of ``width``
    squared from every task, added up by row."""

    def products(batches):
        total = np.zeros((width, width))
        for _, x in _matrices(batches):
            d = rows_of(x)
            total += d.T @ d
        yield _listed(np.arange(width), total)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, row in zip(batch.column("at").to_pylist(), _matrix(batch.column("row"))):
                sums[at] = sums[at] + row if at in sums else row
        if sums:
            yield _listed(list(sums), np.array(list(sums.values())))

    def _listed(at, rows):
        ends = np.arange(len(rows) + 1, dtype=np.int32) * width
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))], ["at", "row"])

    kind = "at int, row array<double>"
    found = fit.mapInArrow(products, kind).repartition("at").mapInArrow(add, kind).collect()
    gram = np.zeros((width, width))
    for r in found:
        gram[r["at"]] = r["row"]
    return (gram + gram.T) / 2


def refine(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (in columns) of a symmetric matrix, to double precision.

    Starts from float32 vectors X. One step forms R = I - X'X and S = X'AX in extended precision and adds X E, where E
    takes R's part that is out of square and S's that is off the diagonal over the gap of the eigenvalues. Gaps below the
    error bound of the step are not divided by: such a cluster is turned by the eigenvectors of its own block of S, less
    its mean value, in which the gaps are as large as the entries.
    """
    size = len(matrix)
    scale = float(np.abs(matrix).max(initial=0))
    if scale == 0:
        return np.zeros(size), np.eye(size)
    wide = matrix.astype(np.longdouble) / scale
    vectors = np.linalg.eigh((matrix / scale).astype(np.float32))[1].astype(np.longdouble)
    one, eps = np.eye(size, dtype=np.longdouble), np.finfo(np.float64).eps
    norm = float(np.linalg.norm(matrix / scale, 2))
    before = np.inf
    for _ in range(STEPS):
        r = one - vectors.T @ vectors
        s = vectors.T @ (wide @ vectors)
        s = (s + s.T) / 2  # else its last digits, over a small gap, bend the vectors out of square
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = 2 * (np.linalg.norm(off.astype(np.float64), 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > error
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        vectors = vectors + vectors @ step
        change = float(np.abs(step).max())
        # Clusters: runs of values in which each is closer to the next than the bound.
        order = np.argsort(values)
        ends = np.flatnonzero(np.diff(values[order]) > error) + 1
        turned = False
        for cluster in np.split(order, ends):
            if len(cluster) > 1:
                own = vectors[:, cluster]
                block = own.T @ (wide @ own)
                block = (block + block.T) / 2 - np.mean(np.diag(block)) * np.eye(len(cluster), dtype=np.longdouble)
                largest = np.abs(block - np.diag(np.diag(block))).max()
                if largest > eps * norm / 8:  # else it is diagonal already, to the last digit
                    vectors[:, cluster] = own @ np.linalg.eigh((block / np.abs(block).max()).astype(np.float64))[1]
                    turned = True
        if not turned and np.abs(r).max() < eps / 8 and (change < eps / 4 or change >= before / 2):  # no digits to gain
            break
        before = change
    for _ in range(2):  # square again what the last step turned by much, inside a cluster
        vectors = vectors @ (1.5 * one - 0.5 * (vectors.T @ vectors))
    values = (vectors * (wide @ vectors)).sum(axis=0) * scale
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    largest = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0)
    return values[order].astype(np.float64), (vectors * np.where(largest < 0, -1, 1)).astype(np.float64)


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums of (n * x - total) ** 2 over the dimensions, exact; None beyond 64 bits."""
    low, high = (int(f(x, initial=0)) for f in (np.min, np.max))
    most = n * max(abs(low), abs(high)) + max(map(abs, total), default=0)
    reach = max((max(abs(n * int(c.max()) - t), abs(n * int(c.min()) - t)) for c, t in zip(x.T, total)), default=0) if len(x) else 0
    if most < 1 << 62 and reach * reach * max(len(total), 1) < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((x.astype(object) * n - np.array(total, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every vector on the leading principal components, scaled to unit variance: a row per vector and component with
    vec_id, component, n, deviation, whitened, explained, identity_error.

    Fitted on the distinct vectors of ``whole_numbers``, n of them: ``deviation`` is the exact sum of (n * x - S)^2 over the
    dimensions, S their sums (null beyond 64 bits); ``whitened`` the centred vector's part along the component over the
    root of its eigenvalue; ``explained`` the eigenvalue's share of the trace; ``identity_error`` how far the covariance of
    ``whitened`` over the fit is from the identity at most. Components are those of the largest eigenvalues, ``components``
    or as many as there are dimensions, with the largest entry positive.

    Vectors of another length than most (of equal counts, the longer) are left out, as are null and non-finite ones.
    A component without variance has ``whitened`` null and does not count in ``identity_error``; without any variance
    ``explained`` and ``identity_error`` are null too. Null and repeated ids are rows like others; of repeated vectors one
    is in the fit. An empty table, and one of empty vectors, gives an empty result.
    """
    spark = embeddings.sparkSession
    valid = stored(whole_numbers(embeddings, id_col, vector_col))
    lengths = valid.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths or not lengths[0]["size"]:
        return spark.createDataFrame([], WHITENED)
    width = lengths[0]["size"]
    rows = valid.where(F.size("x") == width)
    fit = stored(rows.select("x").distinct())  # copies are met in the map tasks first
    n, total = column_sums(fit)
    covariance = _gram(fit, lambda x: _centred(x, n, total), width) / n
    values, vectors = refine(covariance)
    trace, kept = float(np.trace(covariance)), min(components, width)
    values, vectors = values[:kept], vectors[:, :kept]
    live = values > width * np.finfo(np.float64).eps * max(trace, 0)
    root = np.sqrt(np.where(live, values, 1))

    def project(x: np.ndarray) -> np.ndarray:
        return np.where(live, _centred(x, n, total) @ vectors / root, 0)

    identity = _gram(fit, project, kept)[np.ix_(live, live)] / n
    error = float(np.abs(identity - np.eye(int(live.sum()))).max()) if live.any() else None
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0)]

    def out(batches):
        for batch, x in _matrices(batches):
            size = len(x)
            deviation = pa.array(_deviation(x, n, total), pa.int64())
            each = pa.array(np.repeat(np.arange(size), kept))
            dead = np.tile(~live, size)
            columns = [
                batch.column("vec_id").take(each),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)),
                pa.array(np.full(size * kept, n)),
                deviation.take(each),
                pa.array(project(x).reshape(-1), mask=dead),
                pa.array(explained * size, pa.float64()),
                pa.array([error] * (size * kept), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, WHITENED)
