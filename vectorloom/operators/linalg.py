"""Small linear algebra on the driver and the aggregates that feed it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.tables import matrix

PIECE = 16_384
#: Largest residual of a returned eigenpair, relative to the largest eigenvalue.
RESIDUAL = 1e-9
SOLVERS = ("eigh", "svd", "svd_lowrank", "lobpcg")


def summed(df: DataFrame, columns: list[str], kernel: Callable[..., np.ndarray], most: int = 1 << 16) -> np.ndarray | None:
    """The sum over all rows of what ``kernel`` gives for blocks of matrices; None without rows.

    Each task adds up its blocks, of ``most`` rows at most; partial sums are cut into pieces of ``PIECE`` values that meet by position,
    so only one array of the kernel's (fixed) size reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in range(0, batch.num_rows, most):
                part = np.asarray(kernel(*(matrix(c) for c in batch.slice(s, most).columns)), float).reshape(-1)
                total = part if total is None else total + part
        if total is not None:
            cuts = range(0, len(total), PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int64()), pa.array([total[c : c + PIECE].tobytes() for c in cuts], pa.binary())], names=["pos", "x"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("x").to_pylist())
        return pa.table({"pos": table.column("pos").slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})

    got = df.select(*columns).mapInArrow(run, "pos bigint, x binary").groupBy("pos").applyInArrow(add, "pos bigint, x binary").toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(np.asarray(got.column(0)))
    return np.concatenate([np.frombuffer(got.column(1)[int(i)].as_py()) for i in order])


def moments(df: DataFrame, vector: str = "v") -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of the finite rows."""

    def kernel(x: np.ndarray) -> np.ndarray:
        x = x[np.isfinite(x).all(1)]
        one = np.concatenate([np.ones((len(x), 1)), x], 1)
        return one.T @ one

    g = summed(df, [vector], kernel)
    g = g.reshape(int(round(len(g) ** 0.5)), -1)
    n = max(1.0, g[0, 0])
    mean = g[0, 1:] / n
    return g[0, 0], mean, g[1:, 1:] / n - np.outer(mean, mean)


def leading(df: DataFrame, dim: int, vector: str = "v", wide: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, directions, variances) of the ``dim`` directions of largest variance of the finite rows.

    Up to ``wide`` coordinates the covariance is summed in one pass. Beyond, it is only applied: a block of random directions, and what passes
    over the rows make of it, span the leading ones (a randomised range finder, repeated until its residual is small);
    a task then holds a matrix of a few dozen columns instead of a square one.
    """
    first = df.select(vector).first()
    d = len(first[0]) if first is not None else 0
    if d <= wide:
        _, mean, cov = moments(df, vector)
        w, u = np.linalg.eigh(cov)
        return mean, u[:, ::-1][:, :dim], w[::-1][:dim]
    good = lambda x: x[np.isfinite(x).all(1)]
    total = summed(df, [vector], lambda x: np.append(good(x).sum(0), len(good(x))))
    n = max(1.0, total[-1])
    mean = total[:-1] / n

    def apply(q: np.ndarray) -> np.ndarray:
        now = df.sparkSession.sparkContext.broadcast((mean, q))

        def kernel(x: np.ndarray) -> np.ndarray:
            m, q = now.value
            x = good(x) - m
            return x.T @ (x @ q)

        return summed(df, [vector], kernel).reshape(q.shape) / n

    w, u, _ = krylov(apply, d, min(dim, d), rounds=20, tolerance=1e-6)
    return mean, u, w


def gram(df: DataFrame, vector: str = "v") -> np.ndarray:
    """``sum of x x'`` over rows, non-finite elements as 0."""
    g = summed(df, [vector], lambda x: np.nan_to_num(x, posinf=0, neginf=0).T @ np.nan_to_num(x, posinf=0, neginf=0))
    return g.reshape(int(round(len(g) ** 0.5)), -1)


def signed(u: np.ndarray) -> np.ndarray:
    """Each column's sign such that its sum isn't negative; where the sum is nearly zero, its largest entry's."""
    s = u.sum(0)
    weak = np.abs(s) < 1e-9 * np.sqrt(len(u))
    if weak.any():
        s = np.where(weak, u[np.abs(u).argmax(0), np.arange(u.shape[1])], s)
    return u * np.where(s < 0, -1.0, 1.0)


def _ritz(q: np.ndarray, aq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and coordinates of the k leading Ritz pairs, by magnitude, of an orthonormal basis q."""
    small = q.T @ aq
    w, v = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(w), kind="stable")[:k]
    return w[order], v[:, order]


def krylov(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, depth: int = 4, rounds: int = 60, seed: int = 0, tolerance: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, residual) of the k leading eigenpairs: randomised block Krylov bases, restarted until the residual is small.

    A block has as many vectors again as pairs are asked for, so that a cluster of close values fits in.
    """
    width = min(n, 2 * k + 10)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    for _ in range(rounds):
        basis = [x]
        for _ in range(depth - 1):
            if len(basis) * width >= n:
                break
            basis.append(np.linalg.qr(apply(basis[-1]))[0])
        q = np.linalg.qr(np.concatenate(basis, 1)[:, : max(width, n)])[0]
        aq = apply(q)
        w, v = _ritz(q, aq, width)
        x, ax = q @ v, aq @ v
        off = float(np.linalg.norm(ax[:, :k] - x[:, :k] * w[:k], axis=0).max()) / max(1e-300, float(np.abs(w).max()))
        if off <= tolerance:
            break
        x = np.linalg.qr(x)[0]
    return w[:k], x[:, :k], off


def subspace(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenpairs (values, vectors) by magnitude of a symmetric operator that is only applied, never formed."""
    w, v, _ = krylov(apply, n, k, rounds=rounds)
    return w, v


def lobpcg(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, residual): locally optimal steps over the block, its residuals and its last directions."""
    width = min(n, 2 * k + 10)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    ax, p = apply(x), None
    w, v = _ritz(x, ax, width)
    x, ax = x @ v, ax @ v
    for _ in range(rounds):
        r = ax - x * w
        off = float(np.linalg.norm(r[:, :k], axis=0).max()) / max(1e-300, float(np.abs(w).max()))
        if off <= RESIDUAL or n <= width:
            break
        more = r if p is None else np.concatenate([r, p], 1)
        more = more / np.maximum(np.linalg.norm(more, axis=0), 1e-300)
        for _ in range(2):
            more = more - x @ (x.T @ more)
        u, s, _ = np.linalg.svd(more, full_matrices=False)
        more = u[:, s > 1e-8 * s[0]]
        q, aq = np.concatenate([x, more], 1), np.concatenate([ax, apply(more)], 1)
        w, v = _ritz(q, aq, width)
        p = more @ v[width:]
        x, ax = q @ v, aq @ v
    return w[:k], x[:, :k], off


def solve_eig(a: np.ndarray, k: int, solver: str = "svd_lowrank", buffer: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(vectors n x k, values) of largest magnitude of a symmetric matrix, signs fixed; reproducible.

    The iterative solvers stop at a small residual. Where their block would span the whole space, or where they don't get
    there, the matrix is decomposed in full: every solver gives the same pairs.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver: {solver}")
    n = len(a)
    k = min(n, k)
    b = a + buffer * np.eye(n) if buffer else a
    off = np.inf
    if solver in ("svd_lowrank", "lobpcg") and n > 6 * (2 * k + 10):
        w, v, off = (krylov if solver == "svd_lowrank" else lobpcg)(lambda q: b @ q, n, k)
    if solver == "svd":
        v, s, vh = np.linalg.svd(b)
        w = s * np.where((v * vh.T).sum(0) < 0, -1.0, 1.0)
    elif off > RESIDUAL:
        w, v = np.linalg.eigh(b)
    order = np.argsort(-np.abs(w), kind="stable")[:k]
    return signed(v[:, order]), w[order] - buffer


def procrustes(m: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to ``m``."""
    u, _, vh = np.linalg.svd(m)
    return u @ vh
