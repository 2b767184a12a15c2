"""Embedding whitening: float32 eigenvectors of a distributed covariance, refined in higher precision.

Vectors become integers ``x = floor(64 c) + 1000000``.  Spark computes the sums and, centred, the covariance: each task
subtracts the rounded mean before it multiplies and adds exact integer products, so the result does not depend on the
order of the rows; the remaining fraction of the mean (below 1/2) is taken off at the end.  The driver sees d x d numbers.

Eigenvectors start in float32 and are corrected by the iteration of Ogita and Aishima in extended precision: products
``R = I - X'X`` and ``S = X'VX`` give a first-order correction of every pair of columns whose eigenvalues differ enough.
Columns whose eigenvalues lie too close together form a cluster, which a sub-solve of its small matrix ``X_c'VX_c`` turns
first; a cluster that stays together (equal eigenvalues) keeps an orthonormal basis of its space.  The iteration ends
when the corrections are below double precision.

Then the rows are projected and divided by the root of their component's eigenvalue, and one more pass over all rows
measures the covariance of the result against the identity.

Scale: three passes over the vectors, of which only sums of d numbers or d x d numbers leave a task, and one pass that
writes the result; no shuffle of rows.  d is the length of an embedding, some thousands at most.

Edge cases: a row is dropped if its vector is null or empty, holds a null or non-finite entry or one beyond 2^53 / 64,
or has another length than most rows (of lengths equally common, the longest counts); other rows come out once for
each of the first ``k`` components, repeated rows and null ids too; vectors of one dimension, or fewer than k, have as many
components as dimensions; a component without variance (fewer vectors than dimensions, equal vectors) has a null
``whitened`` and does not count for the identity error, which is null if no component is left; ``deviation`` is null
where the exact sum does not fit a long; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import table

#: Components returned.
K = 32
#: Scale and offset of the integers.
SCALE, OFFSET = 64, 1_000_000
#: Rows read at once.
ROWS = 4096
#: An eigenvalue below this share of the largest one, times the dimension, counts as zero.
ZERO = float(np.finfo(np.float64).eps)
#: Most refinements; each squares the error, from about 1e-7.
TURNS = 12
_LIMIT = float(1 << 53)


def _matrices(dims: int | None, batches):
    """(row numbers, integer vectors) of the usable rows of each part of a batch; all lengths if ``dims`` is None."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            column = part.column(1)
            flat, n = column.flatten(), np.asarray(column.value_lengths().fill_null(0))
            values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")))
            scaled = np.floor(values * SCALE)
            good = np.isfinite(values) & (np.abs(scaled) < _LIMIT)
            bad = np.concatenate(([0], np.cumsum(~good)))
            end = np.cumsum(n)
            fine = (n > 0) & (bad[end] == bad[end - n])
            for d in ([dims] if dims else np.unique(n[fine]).tolist()):
                rows = np.flatnonzero(fine & (n == d))
                if len(rows):
                    x = scaled[(end[rows] - d)[:, None] + np.arange(d)].astype(np.int64) + OFFSET
                    yield part, rows, x


def _sum_rows(batches):
    """(dims, n, i, sum) per dimension of each length of vector."""
    import pyarrow as pa

    n, sums = {}, {}
    for _, rows, x in _matrices(None, batches):
        d = x.shape[1]
        n[d] = n.get(d, 0) + len(rows)
        sums[d] = [a + int(b) for a, b in zip(sums.get(d, [0] * d), x.sum(0))]
    for d in n:
        yield pa.record_batch([pa.array([d] * d, pa.int32()), pa.array([n[d]] * d, pa.int64()), pa.array(range(d), pa.int32()),
                               pa.array([str(s) for s in sums[d]])], names=["dims", "n", "i", "s"])


def _exact_products(y: np.ndarray) -> list[np.ndarray]:
    """y'y as float64 matrices of whole numbers below 2^53, whose sum is exact; rounded beyond that."""
    most = float(np.abs(y).max(initial=0))
    step = max(1, int(_LIMIT // max(most * most, 1.0)))
    y = y.astype(np.float64)
    return [y[a:a + step].T @ y[a:a + step] for a in range(0, len(y), step)]


def _product_rows(center: np.ndarray, batches):
    """(i, row): row i of the sum of (x - center)(x - center)', as whole numbers in decimal."""
    import pyarrow as pa

    total = None
    for _, _, x in _matrices(len(center), batches):
        for m in _exact_products(x - center):
            # each is a whole number: add as Python integers only when a 64-bit sum might overflow
            m = m.astype(np.int64) if np.abs(m).max() < 2 ** 61 else m.astype(object)
            if total is None:
                total = m
            elif total.dtype == object or m.dtype == object or max(np.abs(total).max(), np.abs(m).max()) >= 2 ** 61:
                total = total.astype(object) + m.astype(object)
            else:
                total = total + m
    if total is not None:
        d = len(center)
        yield pa.record_batch([pa.array(np.arange(d, dtype=np.int32)), pa.array([[str(int(v)) for v in r] for r in total])],
                              names=["i", "row"])


def _added(df: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of the decimal matrices' entries."""
    cells = df.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return {(r.i, r.j): int(r.v) for r in cells.collect()}


def clusters(values: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Ranges [a, b) of falling eigenvalues whose neighbours lie closer than ``gap``."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:]))


def eigenvectors(v: np.ndarray, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    high = np.longdouble
    a = v.astype(high)
    d = len(a)
    scale = float(np.abs(v).max(initial=0)) or 1.0
    _, x = np.linalg.eigh((v / scale).astype(np.float32))  # scaled: float32 has a small range
    x = x[:, ::-1].astype(high)
    eye, turned = np.eye(d, dtype=high), False
    for turn in range(turns):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = s - np.diag(values)
        gap = 2 * (np.sqrt((off.astype(float) ** 2).sum()) + float(np.abs(values).max()) * np.sqrt((r.astype(float) ** 2).sum()))
        groups = [g for g in clusters(values.astype(float), gap) if g[1] - g[0] > 1]
        if groups and not turned:
            # sub-solves: orthonormalise each cluster's columns, then turn them by the eigenvectors of their own matrix
            for lo, hi in groups:
                own = x[:, lo:hi]
                own = own @ (eye[:hi - lo, :hi - lo] + r[lo:hi, lo:hi] / 2)
                middle = values[lo:hi].mean()
                small = own.T @ (a @ own) - middle * (own.T @ own)
                size = float(np.abs(small).max()) or 1.0
                _, q = np.linalg.eigh((small / size).astype(np.float64))
                x[:, lo:hi] = own @ q[:, ::-1].astype(high)
            turned = True
            continue
        turned = False
        near = np.abs(values[:, None] - values[None, :]) <= gap
        apart = values[None, :] - values[:, None]
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, high(1), apart))
        x = x + x @ e
        if turn and float(np.abs(e).max(initial=0)) < np.finfo(np.float64).eps / 8:
            break
    for _ in range(3):  # what is left of the columns' products, without turning their spaces
        x = x + x @ (eye - x.T @ x) / 2
    x /= np.sqrt((x * x).sum(0))
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


def _whitened(x: np.ndarray, center: np.ndarray, shift: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return ((x - center).astype(np.float64) - shift) @ basis


def _identity_rows(center, shift, basis, batches):
    """(n, sums, products): of the whitened rows of a task, row by row of the product matrix."""
    import pyarrow as pa

    k = basis.shape[1]
    n, sums, total = 0, np.zeros(k), np.zeros((k, k))
    for _, rows, x in _matrices(len(center), batches):
        w = _whitened(x, center, shift, basis)
        n, sums, total = n + len(rows), sums + w.sum(0), total + w.T @ w
    yield pa.record_batch([pa.array([n]), pa.array([sums.tolist()]), pa.array([total.ravel().tolist()])],
                          names=["n", "sums", "products"])


def _result_rows(n: int, sums: list[int], center, shift, basis, use, explained, error, batches):
    import pyarrow as pa

    d, k = len(center), len(explained)
    exact = np.array(sums, object)
    for part, rows, x in _matrices(d, batches):
        w = np.full((len(rows), k), np.nan)
        w[:, use] = _whitened(x, center, shift, basis)
        # n x - S = n (x - center) - (S - n center)
        rest = np.array([int(v) for v in exact - n * center.astype(object)], object)
        far = np.abs(x - center).max(initial=0)
        reach = n * int(far) + int(max(abs(v) for v in rest))
        if reach * reach * d < 2 ** 63:
            diff = n * (x - center) - rest.astype(np.int64)
            deviation = [int(v) for v in (diff * diff).sum(1)]
        else:
            diff = n * (x - center).astype(object) - rest
            deviation = [int(v) for v in (diff * diff).sum(1)]
        deviation = [v if v < 2 ** 63 else None for v in deviation]
        m = len(rows)
        yield pa.record_batch([
            part.column(0).take(pa.array(np.repeat(rows, k))),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
            pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
            pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(explained, m)),
            pa.array([error] * (m * k), pa.float64())],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sums = rows.mapInArrow(_sum_rows, "dims int, n long, i int, s string")
    found = sums.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = found.where("i = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, d = most.n, most.dims
    totals = [int(r.s) for r in found.where(F.col("dims") == d).orderBy("i").collect()]
    center = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    shift = np.array([(s - n * int(c)) / n for s, c in zip(totals, center)])
    cells = _added(rows.mapInArrow(partial(_product_rows, center), "i int, row array<string>"))
    products = np.array([[cells[i, j] for j in range(d)] for i in range(d)], object)
    # sum of (x - S/n)(x - S/n)' times n, exact, before the one division
    left = np.array([s - n * int(c) for s, c in zip(totals, center)], object)
    exact = n * products - np.outer(left, left)
    v = np.array([[int(c) / (n * n) for c in r] for r in exact])
    values, x = eigenvectors(v)
    k = min(k, d)
    trace = float(sum(int(exact[i, i]) for i in range(d)) / (n * n))
    explained = values[:k] / trace if trace > 0 else np.zeros(k)
    use = np.flatnonzero(values[:k] > ZERO * d * max(values[0], 0)) if trace > 0 else np.empty(0, np.int64)
    basis = x[:, use] / np.sqrt(values[use])
    error = None
    if len(use):
        got = rows.mapInArrow(partial(_identity_rows, center, shift, basis), "n long, sums array<double>, products array<double>")

        def added(c):
            cells = got.select(F.posexplode(c).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("v"))
            return np.array([r.v for r in sorted(cells.collect(), key=lambda r: r.j)])

        mean = added("sums") / n
        error = float(np.abs(added("products").reshape(len(use), len(use)) / n - np.outer(mean, mean) - np.eye(len(use))).max())
    return rows.mapInArrow(partial(_result_rows, n, totals, center, shift, basis, use, explained, error), schema)


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
