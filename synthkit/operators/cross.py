"""Mergeable cross-product matrices: moments of all column pairs in one scan.

Each task keeps k x k matrices over the rows that have both columns of a pair: counts, means, sums of squared
deviations and of deviation products.  A batch of rows adds to them by three matrix products, so a row costs k
values and no row is copied.  Two sets are merged by the pairwise update of means and deviations (no large sums
are subtracted).  Tasks give one row for each column; these k rows a task are dealt by column and merged there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = ("n", "mean", "mean_t", "dev", "dev_t", "prod")
_ROW = "i int, " + ", ".join(f"{p} array<double>" for p in _PARTS)


def batch_moments(values: pa.ListArray, k: int) -> tuple[np.ndarray, ...]:
    """(n, mean, dev, prod) matrices of a batch; entry [i, j] is of column i over the rows that have i and j."""
    flat = values.flatten()
    has = np.asarray(flat.is_valid()).reshape(-1, k)
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, k)
    x = np.where(has, x, np.nan)
    mask = has.astype(np.float64)
    n = mask.T @ mask
    with np.errstate(invalid="ignore", divide="ignore"):
        count = np.diag(n)
        low, high = np.fmin.reduce(x, axis=0), np.fmax.reduce(x, axis=0)
        shift = np.where(low == high, low, np.nansum(x, axis=0) / count)  # exact for a constant column
        shift = np.where(count > 0, shift, 0.0)
        y = np.where(has, x - shift, 0.0)
        total = y.T @ mask
        mean = np.where(n > 0, total / n, 0.0)
        dev = (y * y).T @ mask - mean * total
        prod = y.T @ y - n * mean * mean.T
    return n, mean + shift[:, None], np.maximum(dev, 0.0), prod


def merge(a, b, mean_t_a=None, mean_t_b=None):
    """Moments of two sets of rows together; the transposed means are given where only one row of the matrices is at hand."""
    (na, ma, va, ca), (nb, mb, vb, cb) = a, b
    n = na + nb
    share = np.divide(na * nb, n, out=np.zeros_like(n), where=n > 0)
    ta, tb = (ma.T, mb.T) if mean_t_a is None else (mean_t_a, mean_t_b)
    d, t = np.where((na > 0) & (nb > 0), mb - ma, 0.0), np.where((na > 0) & (nb > 0), tb - ta, 0.0)
    part = np.divide(nb, n, out=np.zeros_like(n), where=n > 0)
    mean = np.where(na > 0, ma + d * part, mb)
    return n, mean, va + vb + d * d * share, ca + cb + d * t * share


def pair_moments(df: DataFrame, columns: list[Column]) -> DataFrame:
    """One row for each column i with arrays over the columns j, over the rows that have both: ``n``, ``mean`` and
    ``dev`` (squared deviations) of i, ``mean_t`` and ``dev_t`` of j, ``prod`` (deviation products)."""
    k = len(columns)

    def scan(batches):
        state = None
        for b in batches:
            if b.num_rows:
                found = batch_moments(b.column(0), k)
                state = found if state is None else merge(state, found)
        if state is not None:
            n, mean, dev, prod = state
            yield rows(range(k), n, mean, mean.T, dev, dev.T, prod)

    def rows(index, *parts):
        return pa.RecordBatch.from_arrays([pa.array(list(index), pa.int32()), *(pa.array([list(r) for r in p], pa.list_(pa.float64())) for p in parts)],
                                          names=["i", *_PARTS])

    def join(batches):
        states: dict[int, tuple] = {}
        for b in batches:
            for i, *parts in zip(b.column(0).to_pylist(), *(b.column(j + 1) for j in range(len(_PARTS)))):
                n, m, mt, v, vt, c = (p.values.to_numpy() for p in parts)
                if i in states:
                    n0, m0, mt0, v0, vt0, c0 = states[i]
                    _, mt1, vt1, _ = merge((n0, mt0, vt0, c0), (n, mt, vt, c), m0, m)
                    n, m, v, c = merge((n0, m0, v0, c0), (n, m, v, c), mt0, mt)
                    mt, vt = mt1, vt1
                states[i] = n, m, mt, v, vt, c
        if states:
            yield rows(states, *([s[p] for s in states.values()] for p in range(len(_PARTS))))

    return df.select(F.array(*columns).alias("x")).mapInArrow(scan, _ROW).repartition("i").mapInArrow(join, _ROW)
