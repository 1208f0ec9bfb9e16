"""Quantiles by sketch brackets: equal to numpy for ties, nulls, few and many values; little is ordered; misses widen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthkit.operators import brackets
from synthkit.operators.profile import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def _table(spark, n, parts):
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(0, 1, n), np.floor(rng.exponential(3, n)), np.where(rng.random(n) < 0.4, 5.0, rng.random(n)),
                  np.where(rng.random(n) < 0.5, np.nan, rng.lognormal(0, 3, n))], axis=1)
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(parts), x


@pytest.mark.parametrize("n,parts", [(1, 1), (2, 1), (37, 3), (20000, 7)])
def test_equal_to_numpy(spark, n, parts):
    df, x = _table(spark, n, parts)
    got = {(r.column, r.prob): r.value for r in quantiles(df, list("abcd"), PROBS).collect()}
    for i, c in enumerate("abcd"):
        values = x[~np.isnan(x[:, i]), i]
        assert sum(k[0] == c for k in got) == (len(PROBS) if len(values) else 0)
        for p in PROBS if len(values) else []:
            want = np.quantile(values, p)
            assert abs(got[c, p] - want) <= 1e-12 * max(1, abs(want)), (c, p)


def test_only_the_brackets_are_ordered(spark, monkeypatch):
    seen = []
    plain = brackets.with_running_sums
    monkeypatch.setattr(brackets, "with_running_sums", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("x"), (F.col("id") % 7).alias("y"))
    got = {(r.column, r.prob): r.value for r in quantiles(df, ["x", "y"], [0.1, 0.5, 0.9]).collect()}
    want = df.agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert got["x", 0.5] == want and got["y", 0.5] == 3 and len(seen) == 1 and seen[0] < 0.02 * 200_000


def test_a_missed_rank_widens_its_bracket(spark, monkeypatch):
    calls = []
    plain = brackets._brackets

    def wrong(spark, wanted, margin):
        calls.append([w[0] for w in wanted])
        return {w[0]: [(-2.0, -1.0)] for w in wanted if w[0] == "x"} | {w[0]: [(0.0, 1e9)] for w in wanted if w[0] != "x"} if margin < 0.1 else plain(spark, wanted, margin)
    monkeypatch.setattr(brackets, "_brackets", wrong)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    got = {r.column: r.value for r in quantiles(df, ["x", "y"], [0.5]).collect()}
    assert got == {"x": 499.5, "y": 499.5} and calls[0] == ["x", "y"] and all(c == ["x"] for c in calls[1:]) and len(calls) > 1


def test_nan_null_and_infinite_values(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, None), (float("inf"), None), (None, None), (-5.0, None)], "x double, y double")
    got = [(r.column, r.prob, r.value) for r in quantiles(df, ["x", "y"], [0.0, 0.5, 1.0]).orderBy("prob").collect()]
    assert got == [("x", 0.0, -5.0), ("x", 0.5, 1.0), ("x", 1.0, float("inf"))]
    assert quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_brackets_are_compared_without_functions_of_arrays(spark, monkeypatch):
    df, _ = _table(spark, 3000, 3)
    ends = {"a": [(-1.0, -0.5), (0.2, 0.4)], "d": [(float("-inf"), 0.1), (1.0, float("inf"))]}
    found = brackets.bracket_counts(df, {c: F.col(c) for c in ends}, ends)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.dtypes == [("column", "string"), ("at", "struct<region:int,x:double>"), ("cnt", "bigint")]
    monkeypatch.setattr(brackets, "PLAIN", 0)  # as for many brackets
    many = brackets.bracket_counts(df, {c: F.col(c) for c in ends}, ends)
    assert sorted(map(str, found.collect())) == sorted(map(str, many.collect()))
