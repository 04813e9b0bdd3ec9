"""Whitening of vectors by their leading principal components, found by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass multiplies a thin block Q by it, as the sum of Xc'(Xc Q) over the partitions of the
centred rows Xc. A few Lanczos passes bound the spectrum from below; then each round damps the unwanted part, from that
bound up to the block's lowest Ritz value, by a Chebyshev polynomial in the covariance, evaluated by its three-term
recurrence at one pass a degree, and turns the block by QR and Rayleigh-Ritz. The round that leaves residuals at the level
of rounding certifies the components. A block that doesn't get there grows, up to the whole space, where Rayleigh-Ritz is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import cut


def scaled(vector: Column, scale: int = 256) -> Column:
    """Entries as whole numbers: floor(scale * entry)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, no null entry and none that isn't finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(rows: DataFrame, d: int, make: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all vectors of what ``make`` gives for a batch, a fixed number of figures: added up within each partition, then by figure across them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    # Whole numbers are added as decimals, which don't overflow.
    sums = rows.mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else "v").alias("v")).collect()
    return np.array([x for _, x in sorted((r.i, int(r.v) if kind == "long" else r.v) for r in sums)], dtype=object if kind == "long" else float)


@dataclass
class Components:
    n: int
    sums: list[int]  # of each dimension, over the fit list
    vectors: np.ndarray  # one column for each component
    values: np.ndarray  # eigenvalues, falling
    trace: float
    identity_error: float
    passes: int


def _lower_bound(times: Callable[[np.ndarray], np.ndarray], d: int, steps: int, rng: np.random.Generator) -> float:
    """What no eigenvalue lies far below: the least Ritz value of a few Lanczos steps less its residual."""
    basis, alphas, betas = [], [], []
    q = rng.standard_normal(d)
    q /= np.linalg.norm(q)
    for _ in range(min(steps, d)):
        basis.append(q)
        w = times(q[:, None])[:, 0]
        alphas.append(q @ w)
        for _ in range(2):  # twice is enough
            for b in basis:
                w = w - (b @ w) * b
        betas.append(np.linalg.norm(w))
        if betas[-1] <= 1e-12 * max(alphas):
            break
        q = w / betas[-1]
    t = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0] - betas[-1]))


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, guard: int = 8, degree: int = 10, steps: int = 8, tolerance: float = 1e-14, rounds: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Leading ``k`` eigenpairs of the covariance that ``times`` multiplies by; residuals are within ``tolerance`` of the largest eigenvalue times the root of ``d``."""
    rng = np.random.default_rng(seed)
    width = min(d, k + guard)
    low = _lower_bound(times, d, steps, rng) if width < d else 0.0
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    done = 0
    while True:
        w = times(q)
        s = q.T @ w
        values, turn = np.linalg.eigh((s + s.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        residual = np.linalg.norm(w[:, :k] - q[:, :k] * values[:k], axis=0).max()
        if width == d or residual <= tolerance * d**0.5 * abs(values[0]):
            return values[:k], q[:, :k]
        if done and done % rounds == 0:  # the unwanted part is too near: take more of it into the block
            more = min(width, d - width)
            q = np.linalg.qr(np.hstack((q, rng.standard_normal((d, more)))))[0]
            width += more
            done += 1
            continue
        high = max(values[-1], low)
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-9 * values[0])
        sigma = first = half / (values[0] - centre)
        before, now = q, (w - centre * q) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (times(now) - centre * now) * (2 * after / half) - (sigma * after) * before
            sigma = after
        q = np.linalg.qr(now)[0]
        done += 1


def fit(vectors: DataFrame, k: int = 4) -> Components | None:
    """Components of the distinct vectors of a table with one column of arrays of whole numbers, all of one length; None without any.

    Directions of no variance are no components.
    """
    rows = cut(vectors.distinct(), "fit-list")
    first = rows.first()
    if first is None or not len(first[0]):
        return None
    d = len(first[0])
    sums = _summed(rows, d, lambda x: np.concatenate((x.sum(axis=0), [len(x)])), "long")
    n, s = int(sums[-1]), [int(v) for v in sums[:-1]]
    mean = np.array([v // n + v % n / n for v in s])
    centred = lambda x: x - mean
    trace = float(_summed(rows, d, lambda x: (centred(x) ** 2).sum(axis=0))[:d].sum() / n)
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return _summed(rows, d, part).reshape(q.shape) / n

    if trace == 0:
        return Components(n, s, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, passes)
    values, q = leading(times, d, min(k, d))
    some = values > 1e-12 * trace
    values, q = values[some], q[:, some]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)  # one sign everywhere
    to = q / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ to
        return np.vstack((y.T @ y, y.sum(axis=0)))

    both = _summed(rows, d, whitened).reshape(len(values) + 1, len(values)) / n
    error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(len(values))).max())
    return Components(n, s, q, values, trace, error, passes)


def whiten(table: DataFrame, k: int = 4, *, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every usable row and component up to ``k``: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out. So are vectors of another length than most have
    (of lengths as common, the longer counts). ``deviation`` is null where it exceeds a long. Fewer dimensions than ``k``, or
    directions without variance: fewer components; a single distinct vector has none, so no rows come out. Repeated rows
    come out each. Equal eigenvalues: any of their vectors, the same for all rows. No rows: none come out. Other columns are ignored.
    """
    spark, kind = table.sparkSession, table.schema[vec_id].dataType.simpleString()
    schema = f"`{vec_id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = table.filter(usable(F.col(vector))).select(F.col(vec_id).alias("_id"), scaled(F.col(vector), scale).alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("x") == common.d)
    found = fit(rows.select("x"), k)
    if found is None:
        return spark.createDataFrame([], schema)
    d, n, sums, to, kept = common.d, found.n, found.sums, found.vectors / np.sqrt(found.values), len(found.values)
    mean = np.array([v // n + v % n / n for v in sums])
    explained, error = found.values / found.trace if found.trace else found.values, found.identity_error
    names = [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not kept:
                continue
            x = _matrix(batch.column(1), d)
            furthest = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
            wide = x.astype(object) if d * furthest**2 >= 1 << 63 else x  # exact in either form
            deviation = ((wide * n - np.array(sums, wide.dtype)) ** 2).sum(axis=1)
            deviation = pa.array([v if v < 1 << 63 else None for v in deviation.tolist()], pa.int64())
            rows = np.repeat(np.arange(len(x)), kept)
            m = len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)), deviation.take(pa.array(rows)),
                                              pa.array(((x - mean) @ to).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(m, error))], names=names)

    return rows.mapInArrow(run, schema)
