"""Rank correlations: ranks once for each column and null pattern, then products of ranks in one scan.

A column's ranks depend on the rows they are taken over: those that hold both columns of a pair.  Columns with the
same null pattern share these rows, so a column is ranked once for each pattern that cuts its rows, not once for
each partner (without nulls: once).  Such a ranking is called a list here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthkit.operators.cross import pair_moments
from synthkit.operators.ordering import with_running_sums, written

_CELLS = 4_000_000  # numbers of a dense block of rows x lists
_ROW = "i int, prod array<double>, dev array<double>, dev_t array<double>"


def null_patterns(both: np.ndarray) -> tuple[list[int], list[list[int]], list[tuple[int, int]]]:
    """From the counts of rows that hold two columns: the pattern of each column (as its first column), for each
    pair of columns [i][j] the list that ranks i over the rows of both, and the lists as (column, pattern)."""
    own = np.diag(both)
    k = len(own)
    pattern = [next(j for j in range(i + 1) if own[j] == own[i] == both[i, j]) for i in range(k)]
    at: dict[tuple[int, int], int] = {}
    use = []
    for i in range(k):
        inside = both[i] == own[i]  # the rows of i all hold j: the plain ranks serve
        use.append([at.setdefault((i, i if inside[j] else pattern[j]), len(at)) for j in range(k)])
    return pattern, use, list(at)


def rank_products(df: DataFrame, columns: list[Column]) -> DataFrame:
    """One row for each column i with arrays over the columns j, over the rows that hold both: ``prod``, ``dev`` and
    ``dev_t``, the sums of products and squares of average ranks less their mean.

    Rows times lists are shuffled twice: to their ranks (by value; a hot value is one row of ranks and is split by
    AQE) and back to their row.  Sums of half integers and their products are exact as long as they fit 53 bits.
    """
    k = len(columns)
    base = written(df.select(F.monotonically_increasing_id().alias("row"), F.array(*columns).alias("x")), "ranked")
    both = np.zeros((k, k))
    for r in pair_moments(base, [F.get("x", F.lit(i)) for i in range(k)]).select("i", "n").collect():  # k x k counts
        both[r.i] = r.n
    pattern, use, lists = null_patterns(both)
    members: dict[int, list[int]] = {}
    for i, p in enumerate(pattern):
        members.setdefault(p, []).append(i)
    # the lists that meet in a pair of patterns: one block of the product matrix
    blocks = [(a, b, [use[i][b[0]] for i in a], [use[j][a[0]] for j in b])
              for p, a in members.items() for q, b in members.items() if p <= q]
    width = len(lists)
    of = np.array(use)

    every = F.array(*[F.struct(F.lit(n).alias("l"), F.lit(i).alias("i"), F.lit(p).alias("p")) for n, (i, p) in enumerate(lists)])
    long = base.select("row", "x", F.explode(every).alias("e")).where("get(x, e.i) IS NOT NULL AND get(x, e.p) IS NOT NULL") \
        .select("row", "e.l", F.get("x", "e.i").alias("v"))
    counts = long.groupBy("l", "v").agg(F.count(F.lit(1)).alias("cnt"))
    cum = with_running_sums(counts, "v", {"cum": F.col("cnt")}, ["l"], total_prefix="all_")
    ranks = cum.select("l", "v", (F.col("cum") - (F.col("cnt") - 1) / 2.0 - (F.col("all_cum") + 1) / 2.0).alias("d"))
    rows = long.join(ranks, ["l", "v"]).groupBy("row").agg(F.collect_list(F.struct("l", "d")).alias("e")).select("e")

    def scan(batches):
        prod, square = np.zeros((k, k)), np.zeros(width)
        for b in batches:
            step = max(1, _CELLS // width)
            for start in range(0, b.num_rows, step):
                part = b.column(0).slice(start, step)
                size = np.diff(part.offsets.to_numpy())
                at, d = part.flatten().flatten()
                x = np.zeros((len(size), width))
                x[np.repeat(np.arange(len(size)), size), at.to_numpy()] = d.to_numpy()
                square += (x * x).sum(axis=0)
                for a, c, left, right in blocks:
                    prod[np.ix_(a, c)] += x[:, left].T @ x[:, right]
        for a, c, _, _ in blocks:
            prod[np.ix_(c, a)] = prod[np.ix_(a, c)].T
        dev = square[of]
        yield arrays(range(k), prod, dev, dev.T)

    def arrays(index, *parts):
        return pa.RecordBatch.from_arrays([pa.array(list(index), pa.int32()), *(pa.array([list(r) for r in p], pa.list_(pa.float64())) for p in parts)],
                                          names=["i", "prod", "dev", "dev_t"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, *parts in zip(b.column(0).to_pylist(), *(b.column(j) for j in (1, 2, 3))):
                total[i] = total.get(i, 0.0) + np.array([p.values.to_numpy() for p in parts])
        if total:
            yield arrays(total, *(([t[p] for t in total.values()]) for p in range(3)))

    return rows.mapInArrow(scan, _ROW).repartition("i").mapInArrow(add, _ROW)
