"""Embedding whitening by spectral divide and conquer on polar factors (QDWH)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import integer_matrix, integer_vectors, materialize

SCALE, SHIFT = 1024, 100_000  # an entry c becomes floor(SCALE * c) + SHIFT
COMPONENTS = 8
ROWS = 4096
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QR form of the dynamically weighted Halley iteration.

    The weights follow a lower bound of the smallest singular value, at first the rounding level, so about six
    steps suffice whatever the condition."""
    eye = np.eye(len(a))
    x = a / np.abs(a).sum(1).max()
    low = EPS
    for _ in range(40):
        low2 = low * low
        d = np.cbrt(4 * (1 - low2) / low2 ** 2)
        r = np.sqrt(1 + d)
        wa = r + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low2) / (low2 * r))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:len(a)] @ q[len(a):].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low2) / (1 + wc * low2))
        if moved <= np.cbrt(4 * EPS) and 1 - low < 10 * EPS:
            break
    return x


def divide(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, the one of the larger eigenvalues first; None where the
    matrix is a multiple of the identity to rounding.

    (polar factor of a - s + identity) / 2 projects on the eigenvectors above the shift s. The mean of the
    eigenvalues always lies between the smallest and the largest; other shifts are tried where one comes too
    close to it, which the coupling left between the two subspaces shows."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * scale:
        return None
    best = None
    for step in (0.0, 0.3, -0.3, 0.1, -0.1, 0.6, -0.6, 0.03, -0.03):
        c = (polar(a - (mean + step * spread / np.sqrt(n)) * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(c)))
        if not 0 < rank < n:
            continue
        v = np.random.default_rng(n).standard_normal((n, rank))
        for _ in range(3):  # the projector's range
            v, _ = np.linalg.qr(c @ v)
        whole, _ = np.linalg.qr(v, mode="complete")
        up, down = whole[:, :rank], whole[:, rank:]
        left = np.linalg.norm(down.T @ a @ up)
        if best is None or left < best[0]:
            best = (left, up, down)
        if left <= 16 * n * EPS * scale:
            break
    return best[1:] if best else None


def leading(a: np.ndarray, k: int, scale: float | None = None) -> np.ndarray:
    """The first ``k`` unit eigenvectors of a symmetric matrix by falling eigenvalue, as columns: subspaces are
    divided until they hold one component (or equal eigenvalues); those that are not among the first ``k``
    are left whole."""
    n = len(a)
    scale = scale or max(np.linalg.norm(a), np.finfo(float).tiny)
    halves = divide(a, scale) if n > 1 and k > 0 else None
    if halves is None:
        return np.eye(n)[:, np.argsort(-np.diag(a), kind="stable")[:k]]
    out = []
    for basis in halves:
        part = basis.T @ a @ basis
        out.append(basis @ leading((part + part.T) / 2, min(k, basis.shape[1]), scale))
        k -= out[-1].shape[1]
        if k <= 0:
            break
    return np.hstack(out)


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the first ``k`` components whose eigenvalue is above rounding;
    the largest entry of a vector is positive."""
    if not len(cov):
        return np.zeros(0), np.zeros((0, 0))
    v, _ = np.linalg.qr(leading(cov, min(k, len(cov))))
    e = np.einsum("ij,ij->j", v, cov @ v)
    order = np.argsort(-e, kind="stable")
    e, v = e[order], v[:, order]
    on = e > len(cov) * EPS * max(np.trace(cov), 0)
    v = v[:, on] * np.where(v[np.abs(v).argmax(0), np.arange(len(e))] < 0, -1.0, 1.0)[on]
    return e[on], v


def product(y: np.ndarray) -> np.ndarray:
    """y' y of integers, exactly: in doubles while every sum stays below 2**53, else in Python's integers."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < 1 << 53:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components_up_to: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every whole vector and each of the
    first ``components_up_to`` principal components.

    Entries become integers x = floor(scale * c) + shift. Sums S, and the covariance (divisor n) of what is
    left after the nearest integer to each mean is subtracted, are exact integers and so do not depend on
    order, partitions or repeated tasks. The driver gets one number per pair of dimensions, divides the
    covariance by polar factors into its components, and sends them back (dimensions x components numbers, the
    bound of the broadcast). ``whitened``: (x - S / n) on the component, over the root of its eigenvalue;
    ``deviation``: sum of (n x - S)**2, exact, decimal(38); ``explained``: eigenvalue over the trace;
    ``identity_error``: largest absolute entry of the whitened rows' covariance minus the identity, from a pass
    of its own.

    Dropped: null vectors and vectors with a null or non-finite entry. Shorter vectors count as filled up with
    zeros to the longest. A component whose eigenvalue is not above rounding (fewer dimensions or rows than
    asked for, equal rows) is not returned: nothing varies along it. Repeated and null ids: each row for
    itself. An empty table gives an empty result. Other columns are ignored."""
    ints = materialize(integer_vectors(vectors, id_col, vector_col, scale, shift), "whitening-in")
    width = ints.agg(F.max(F.size("x"))).first()[0] or 0
    # few tasks: each gives as many rows as there are pairs of dimensions
    few = ints.select("x").coalesce(max(1, 4 * ints.sparkSession.sparkContext.defaultParallelism))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, object), 0
        for b in batches:
            x = integer_matrix(b.column("x"), width, shift)
            total, n = total + x.astype(object).sum(0) if len(x) else total, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.int64()), pa.array([n] * width, pa.int64())], ["i", "total", "n"])

    s = few.mapInArrow(sums, "i int, total long, n long").groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
    n, total = (s[0]["n"], np.array([r["total"] for r in s], object)) if s else (0, np.zeros(width, object))
    near = np.array([(2 * int(t) + n) // (2 * n) for t in total], np.int64)  # nearest integer to the mean
    i_of, j_of = np.triu_indices(width)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width), object)
        for b in batches:
            x = integer_matrix(b.column("x"), width, shift) - near
            for at in range(0, len(x), ROWS):
                out = out + product(x[at:at + ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(i_of, pa.int32()), pa.array(j_of, pa.int32()), pa.array(out[i_of, j_of].tolist(), pa.int64())], ["i", "j", "total"])

    cov = np.zeros((width, width))
    rest = [int(t) - n * int(m) for t, m in zip(total, near)]  # at most n / 2 each
    if n:
        for r in few.mapInArrow(scatter, "i int, j int, total long").groupBy("i", "j").agg(F.sum("total").alias("total")).toPandas().itertuples():
            cov[r.i, r.j] = cov[r.j, r.i] = (n * int(r.total) - rest[r.i] * rest[r.j]) / (n * n)
    values, axes = components(cov, components_up_to)
    m = len(values)
    trace = float(np.trace(cov))
    sums_of = total.astype(np.int64)
    axes = axes / np.sqrt(values) if m else np.zeros((width, 0))

    def centred(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S as integers, whitened rows)"""
        x = integer_matrix(column, width, shift)
        top = max(int(np.abs(x).max(initial=0)) * n, int(np.abs(sums_of).max(initial=0)))
        dev = (n * x - sums_of) if top < 1 << 62 else (x.astype(object) * n - sums_of.astype(object))
        return dev, (dev / n).astype(float) @ axes if n else np.zeros((0, m))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mean = np.zeros((m, m)), np.zeros(m)
        for b in batches:
            w = centred(b.column("x"))[1]
            out, mean = out + w.T @ w, mean + w.sum(0)
        i, j = np.indices((m, m)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(out.ravel()), pa.array(mean[i])], ["i", "j", "total", "mean"])

    error = 0.0
    if m:
        got = np.zeros((m, m))
        mean = np.zeros(m)
        for r in few.mapInArrow(spread, "i int, j int, total double, mean double").groupBy("i", "j").agg(
                F.sum("total").alias("total"), F.sum("mean").alias("mean")).collect():
            got[r["i"], r["j"]], mean[r["i"]] = r["total"] / n, r["mean"] / n
        error = float(np.abs(got - np.outer(mean, mean) - np.eye(m)).max())
    explained = values / trace if m else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dev, w = centred(b.column("x"))
            top = int(np.abs(dev).max(initial=0))
            if top * top * width < 1 << 62:
                square = pa.array((dev.astype(np.int64) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                square = pa.array([int(v) for v in (dev.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
            at = pa.array(np.repeat(np.arange(b.num_rows), m))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(at), pa.array(np.tile(np.arange(1, m + 1), b.num_rows), pa.int32()), pa.array(np.full(b.num_rows * m, n), pa.int64()),
                 square.take(at), pa.array(w.ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(b.num_rows * m, error))],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return (ints.mapInArrow(project, "_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
            .withColumnRenamed("_id", id_col))
