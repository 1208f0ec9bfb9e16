"""Correlations by cross-product matrices: nulls, shifts, constants, many columns, any partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthkit.operators.profile import correlations


def plain(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) == 0 or a.min() == a.max() or b.min() == b.max():
        return None
    return float(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_to_numpy_with_nulls_in_different_rows(spark, parts):
    rng = np.random.default_rng(4)
    n, k = 600, 6
    x = rng.normal(0, 1, (n, k)) @ rng.normal(0, 1, (k, k))
    x[:, 1] += 1e6  # a large shift
    x[:, 2] = 0.1  # constant
    x[rng.random((n, k)) < 0.3] = np.nan
    x[:, 5] = np.nan
    cols = list("abcdef")
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(parts)
    got = {(r.a, r.b): r.r for r in correlations(df, cols).collect()}
    assert len(got) == 15
    for i in range(k):
        for j in range(i + 1, k):
            want, r = plain(x, i, j), got[cols[i], cols[j]]
            assert (r is None) == (want is None) and (want is None or abs(r - want) < 1e-6), (i, j, r, want)


def test_three_hundred_columns(spark):
    df = spark.range(2000).select(*[(F.sin(F.col("id") * (i + 1)) + F.col("id") * (i % 3)).alias(f"c{i}") for i in range(300)])
    got = correlations(df, df.columns)
    assert got.count() == 300 * 299 // 2
    some = got.where("a = 'c1' and b in ('c2', 'c298')").collect()
    want = df.agg(F.corr("c1", "c2").alias("c2"), F.corr("c1", "c298").alias("c298")).first()
    assert len(some) == 2 and all(abs(r.r - want[r.b]) < 1e-9 for r in some)
    assert correlations(df.limit(0), ["c0", "c1"]).count() == 0
