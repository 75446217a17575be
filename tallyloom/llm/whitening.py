"""Whitening of embeddings: a covariance in double-double over tasks, and its principal components.

Entries are turned into whole steps, so the number of distinct vectors and their sums are exact. Products of centred entries are
split without error into a double and its rounding, and both are summed as double-doubles; tasks hand on high and low parts,
which are merged by the same sum.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .scratch import materialize, tidy

#: Splits a double of 53 bits into two of 26.
_SPLITTER = float(2**27 + 1)
#: Cells of the covariance that travel in one row.
_CELLS = 128


def two_sum(a, b):
    """a + b as a double and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b as a double and its rounding error, for factors below 2^996."""
    p = a * b
    t = _SPLITTER * a
    a1 = t - (t - a)
    t = _SPLITTER * b
    b1 = t - (t - b)
    a2, b2 = a - a1, b - b1
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


class DoubleDoubleSum:
    """Sums of doubles, or of double-doubles, in each cell of an array."""

    def __init__(self, shape):
        self.high, self.low = np.zeros(shape), np.zeros(shape)

    def add(self, high, low=0.0) -> None:
        s, e = two_sum(self.high, high)
        self.high, self.low = two_sum(s, e + (self.low + low))


def parts(value: Fraction) -> tuple[float, float]:
    """The double-double next to a fraction."""
    high = float(value)
    return high, float(value - Fraction(high))


def centred(x: np.ndarray, mean_high: np.ndarray, mean_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x - mean for rows of integers, as double-doubles."""
    high = x.astype(np.float64)
    rest = (x - high.astype(np.int64)).astype(np.float64) if np.abs(high).max(initial=0) >= 2**53 else 0.0
    s, e = two_sum(high, -mean_high)
    return two_sum(s, e + (rest - mean_low))


def outer_sums(high: np.ndarray, low: np.ndarray, into: DoubleDoubleSum, i: np.ndarray, j: np.ndarray) -> None:
    """Add the products of entries i and j of all rows to `into`, whose rows take the given rows by turns."""
    lanes = len(into.high)
    for s in range(0, len(high), lanes):
        h, w = high[s : s + lanes], low[s : s + lanes]
        if len(h) < lanes:
            h, w = (np.concatenate([v, np.zeros((lanes - len(v), v.shape[1]))]) for v in (h, w))
        a, b = h[:, i], h[:, j]
        p, e = two_product(a, b)
        into.add(p, e + (a * w[:, j] + w[:, i] * b))


def _rows(batch: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def stepped(vector, steps: int):
    """floor(steps * c) as long for each entry c, and whether all entries are finite numbers."""
    fine = vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.transform(vector, lambda c: F.floor(c.cast("double") * steps).cast("long")), F.coalesce(fine, F.lit(False))


def exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows (x array<long>) and the exact sum of each of their entries; tasks send one row an entry."""

    def run(batches):
        n, sums = 0, [0] * size
        for batch in batches:
            x = _rows(batch, "x", size)
            n += len(x)
            for s in range(0, len(x), 1 << 20):  # two halves of 32 bits, so that no sum overflows
                v = x[s : s + (1 << 20)]
                upper, lower = (v >> 32).sum(axis=0).tolist(), (v & 0xFFFFFFFF).sum(axis=0).tolist()
                sums = [t + (u << 32) + w for t, u, w in zip(sums, upper, lower, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(size), pa.int32()), "n": pa.array([n] * size, pa.int64()), "high": pa.array([t >> 40 for t in sums], pa.int64()), "low": pa.array([t & ((1 << 40) - 1) for t in sums], pa.int64())})

    parts_ = map_arrow(fit.select("x"), run, "at int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts_.groupBy("at").agg(F.sum("n").alias("n"), wide("high"), wide("low")).orderBy("at").collect()  # one for each dimension
    return (rows[0].n, [(int(r.high) << 40) + int(r.low) for r in rows]) if rows else (0, [])


def covariance(vectors: DataFrame, size: int, n: int, centre) -> tuple[np.ndarray, np.ndarray]:
    """The covariance of n rows, divisor n, as high and low parts. centre turns a batch into centred rows, as double-doubles.

    Each task sums the upper triangle and sends it in blocks of cells, which other tasks merge; the driver gets one
    double-double for each cell, so nothing that grows with the rows passes it.
    """
    i, j = np.triu_indices(size)
    lanes = max(1, (1 << 14) // len(i))
    schema = "block int, high array<double>, low array<double>"

    def blocks(high, low):
        cut = range(0, len(i), _CELLS)
        lists = [pa.array([v[s : s + _CELLS] for s in cut], pa.list_(pa.float64())) for v in (high, low)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), *lists], names=["block", "high", "low"])

    def within(batches):
        total, some = DoubleDoubleSum((lanes, len(i))), False
        for batch in batches:
            if batch.num_rows:
                some = True
                outer_sums(*centre(batch), total, i, j)
        if some:
            one = DoubleDoubleSum(len(i))
            for h, w in zip(total.high, total.low, strict=True):
                one.add(h, w)
            yield blocks(one.high, one.low)

    def merge(batches):
        sums: dict[int, DoubleDoubleSum] = {}
        for batch in batches:
            for block, high, low in zip(*(batch.column(c) for c in ("block", "high", "low")), strict=True):
                h, w = high.values.to_numpy(), low.values.to_numpy()
                sums.setdefault(block.as_py(), DoubleDoubleSum(len(h))).add(h, w)
        if sums:
            lists = [pa.array([getattr(s, k) for s in sums.values()], pa.list_(pa.float64())) for k in ("high", "low")]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *lists], names=["block", "high", "low"])

    merged = map_arrow(map_arrow(vectors, within, schema).repartition("block"), merge, schema).orderBy("block").collect()
    out = []
    for k in ("high", "low"):
        full = np.zeros((size, size))
        full[i, j] = np.concatenate([r[k] for r in merged])
        full.T[i, j] = full[i, j]
        out.append(full)
    # the division by n, with the remainder of the high part
    high = out[0] / n
    p, e = two_product(high, float(n))
    return high, ((out[0] - p) - e + out[1]) / n


def principal(high: np.ndarray, low: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, of a symmetric matrix given in two parts.

    LAPACK reduces the high part to tridiagonal form and solves that by divide and conquer. As its vectors are off by rounding
    over the gap between eigenvalues, each is corrected once by the residual of both parts in extended precision.
    """
    size = len(high)
    values, vectors = np.linalg.eigh(high)  # syevd
    wide = vectors[:, ::-1].astype(np.longdouble)
    k = min(most, size)
    top = wide[:, :k]
    overlap = -(wide.T @ top)
    overlap[np.arange(k), np.arange(k)] += 1
    turned = wide.T @ ((high.astype(np.longdouble) + low) @ top)
    own = np.array([turned[c, c] / (1 - overlap[c, c]) for c in range(k)])
    rough = values[::-1].astype(np.longdouble)
    scale = np.abs(values).max(initial=0) * size * np.finfo(float).eps
    for c in range(k):
        rough[c] = own[c]
    gap = own[None, :] - rough[:, None]
    apart = np.abs(gap) > scale
    step = np.where(apart, (turned + own[None, :] * overlap) / np.where(apart, gap, 1), overlap / 2)
    better = top + wide @ step
    better /= np.sqrt((better * better).sum(axis=0))
    return own.astype(np.float64), better.astype(np.float64)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[list | np.ndarray, np.ndarray]:
    """For each row the sum of (n x - S)^2, None where a long can't hold it, and n x - S as doubles."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if reach**2 * len(sums) < 1 << 63:
        d = n * x - np.array(sums, dtype=np.int64)
        return (d * d).sum(axis=1), d.astype(np.float64)
    exact = n * x.astype(object) - np.array(sums, dtype=object)
    total = (exact * exact).sum(axis=1).tolist()
    return [t if t < 1 << 63 else None for t in total], exact.astype(np.float64)


@tidy
def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", steps: int = 256, most: int = 4) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to `most`.

    An entry c becomes x = floor(steps * c). The fit list holds each distinct x once: n of them with sums S; V is their
    covariance, divisor n. whitened is x - S/n projected on a unit eigenvector of V, over the root of its eigenvalue; the sign of a
    component is arbitrary and the same for all rows. deviation is the exact sum of (n x - S)^2, null where a long can't hold it.
    explained is the eigenvalue's share of the trace. identity_error is the largest absolute entry of the covariance of
    whitened over the fit list, less the identity.

    Rows whose vector is null, empty or holds null or non-finite entries go, and so do vectors of another length than the
    most frequent one (the shorter among equally frequent). Rows that repeat are rows of their own with equal results, and count once
    in the fit list; null ids stay. A component without variance (all of one distinct vector) has null for whitened, and takes no part
    in identity_error; without any variance explained and identity_error are null too. A table without fit rows gives none. Other
    columns are ignored, so their names can't clash.
    """
    x, fine = stepped(F.col(vector_col), steps)
    kept = embeddings.filter(fine).select(F.col(id_col).alias("id"), x.alias("x"))
    kind = embeddings.schema[id_col].dataType.simpleString()
    length = kept.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if length is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    size = length["size"]
    kept = kept.filter(F.size("x") == size)
    fit = materialize(kept.select("x").distinct(), "distinct-vectors")
    n, sums = exact_sums(fit, size)
    mean_high, mean_low = (np.array(p) for p in zip(*(parts(Fraction(s, n)) for s in sums), strict=True))
    high, low = covariance(fit, size, n, lambda batch: centred(_rows(batch, "x", size), mean_high, mean_low))
    values, vectors = principal(high, low, most)
    trace = float(np.trace(high))
    some = values > max(0.0, float(values[0])) * size * np.finfo(float).eps
    scaled = np.divide(vectors, np.sqrt(np.where(some, values, 1)))
    error = None
    if some.any():
        def projected(batch):
            y = (_deviations(_rows(batch, "x", size), n, sums)[1] @ scaled[:, some]) / n
            return y, np.zeros_like(y)

        white = sum(covariance(fit, int(some.sum()), n, projected))
        error = float(np.abs(white - np.eye(len(white))).max())
    explained = [float(v) / trace if trace > 0 else None for v in values]
    k = len(values)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            deviation, d = _deviations(_rows(batch, "x", size), n, sums)
            y = d @ scaled / n
            null = np.tile(~some, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, dtype=np.int64)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(y.ravel(), mask=null),
                    pa.array(explained * rows, pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(kept, run, schema)
