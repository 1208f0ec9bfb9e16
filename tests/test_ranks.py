"""Rank correlations against plain ranks: nulls in different rows, nested patterns, ties; rows shuffled stay about n x k."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthkit.operators.profile import rank_correlations
from synthkit.operators.ranks import null_patterns


def _both(x):
    has = (~np.isnan(x)).astype(float)
    return has.T @ has


@pytest.mark.parametrize("parts", [1, 6])
def test_equal_to_plain_ranks(spark, parts):
    rng = np.random.default_rng(8)
    n, k = 500, 8
    x = np.round(rng.normal(0, 1, (n, k)) @ rng.normal(0, 1, (k, k)), 1)  # many ties
    x[rng.random(n) < 0.4, 1] = np.nan
    x[:, 2] = np.where(np.isnan(x[:, 1]), np.nan, x[:, 2])  # the pattern of column 1
    x[:, 3] = np.where(rng.random(n) < 0.3, np.nan, x[:, 1])  # inside it
    x[rng.random(n) < 0.3, 4] = np.nan
    x[:, 5] = 7.0
    x[:, 6] = np.nan
    cols = list("abcdefgh")
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols))
    got = {(r.a, r.b): r.r for r in rank_correlations(df.repartition(parts), cols).collect()}
    assert len(got) == k * (k - 1) // 2
    for (a, b), r in got.items():
        two = pd.DataFrame({"a": x[:, cols.index(a)], "b": x[:, cols.index(b)]}).dropna().rank()
        want = two.a.corr(two.b) if len(two) > 1 and two.a.std() > 0 and two.b.std() > 0 else None
        assert (r is None) == (want is None) and (want is None or abs(r - want) < 1e-9), (a, b, r, want)


def test_lists_follow_null_patterns_not_pairs():
    x = np.ones((50, 12))
    assert len(null_patterns(_both(x))[2]) == 12  # no nulls: each column is ranked once
    x[:20, 6:] = np.nan
    pattern, use, lists = null_patterns(_both(x))
    assert pattern == [0] * 6 + [6] * 6 and len(lists) == 6 * 2 + 6  # the fuller columns also over the rows of the others
    assert use[0][1] != use[0][7] and use[7][0] == use[7][8]


def test_no_rows_and_many_columns(spark):
    df = spark.range(400).select(*[(F.sin(F.col("id") * (i + 1)) + F.col("id") * (i % 3)).alias(f"c{i}") for i in range(60)])
    got = rank_correlations(df, df.columns)
    assert got.count() == 60 * 59 // 2
    pdf = df.select("c1", "c50").toPandas().rank()
    assert abs(got.where("a = 'c1' and b = 'c50'").first().r - pdf.c1.corr(pdf.c50)) < 1e-9
    none = rank_correlations(df.limit(0), ["c0", "c1"]).collect()
    assert [tuple(r) for r in none] == [("c0", "c1", None)]
