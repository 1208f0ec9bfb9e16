"""Numbers, dates and categories under one copula: associations of the source come back, rare predicates too."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthkit.operators import copula, rules
from synthkit.operators.synth import synthesize
from synthkit.plans.spec import infer_spec

N = 20_000


@pytest.fixture(scope="module")
def source(spark):
    rng = np.random.default_rng(3)
    m = np.array([[1, .6, -.5, .4], [.6, 1, -.3, .2], [-.5, -.3, 1, -.45], [.4, .2, -.45, 1]])
    z = rng.multivariate_normal(np.zeros(4), m, N)
    u = np.array([[0.5 * math.erfc(-x / math.sqrt(2)) for x in r] for r in z])
    # names out of the order of their means, shares far from equal
    tier = np.array(["mid", "low", "top", "rare"])[np.searchsorted([0.55, 0.8, 0.97], u[:, 1])]
    flag = np.where(u[:, 3] < 0.3, "b", "a")
    day = [datetime.date(2023, 1, 1) + datetime.timedelta(int(x * 1000)) for x in u[:, 2]]
    return spark.createDataFrame(pd.DataFrame({"x": 10 + 2 * z[:, 0], "tier": tier, "day": day, "flag": flag})).cache()


def ranks(df):
    p = df.toPandas()
    return pd.DataFrame({"x": p.x, "tier": p.tier.map({"mid": 0, "low": 1, "top": 2, "rare": 3}), "day": pd.to_datetime(p.day).astype("int64"),
                         "flag": (p.flag == "a").astype(int)}).rank().corr().to_numpy()


def test_associations_of_mixed_columns_come_back(spark, source):
    spec = infer_spec(source, seed=5)
    assert len(spec["corr"]) == 6
    made = synthesize(spark, spec, rows=N)
    assert np.abs(ranks(made) - ranks(source)).max() <= 0.04
    share = lambda df: df.groupBy("tier").count().toPandas().set_index("tier")["count"] / N
    assert (share(made) - share(source)).abs().max() < 0.015


def test_rare_predicates_on_linked_columns(spark, source):
    spec = infer_spec(source, seed=5)
    rows, report = rules.edge_cases(spark, spec, "day <= '2023-01-02' AND tier = 'rare'", 20)
    got = rows.collect()
    assert len(got) == 20 and all(r.tier == "rare" and r.day <= datetime.date(2023, 1, 2) for r in got)


def test_rank_series():
    smooth = copula.rank_series()
    assert abs(float(smooth @ smooth) - 1) < 1e-6
    for rho in (-0.9, -0.3, 0.0, 0.5, 0.8):
        assert abs(copula.latent(6 / math.pi * math.asin(rho / 2), smooth, smooth) - rho) < 1e-6
    half = copula.rank_series([0.5, 0.5])  # two halves: the sign of the normal
    assert abs(copula.latent(2 / math.pi * math.asin(0.6), half, half) - 0.6) < 1e-3
    assert not copula.rank_series([1.0]).any() and not copula.rank_series([0.0, 2.0]).any()


def test_normals_are_not_repeated(spark):
    names = [f"c{i}" for i in range(40)]
    spec = {"rows": 10, "seed": 1, "corr": [[a, b, 0.3] for i, a in enumerate(names) for b in names[i + 1:]], "corr_kind": "latent",
            "columns": [{"name": n, "type": "float", "spark_type": "double", "dist": {"family": "gaussian", "mu": 0.0, "sigma": 1.0}} for n in names]}
    made = synthesize(spark, spec)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 4 * len(names)  # grows with the columns, not with their pairs
    assert made.count() == 10


def test_columns_that_cannot_be_linked(spark):
    df = spark.createDataFrame([(i, "same", None if i % 2 else "x") for i in range(100)], "n long, c string, d string")
    spec = infer_spec(df)
    assert all(abs(r) <= copula.MOST for *_, r in spec["corr"])
    assert synthesize(spark, spec).agg(F.count("c")).first()[0] == 100
    assert infer_spec(df, with_corr=False)["corr"] == []


def test_columns_of_nulls_are_not_linked(spark):
    df = spark.range(60).select("id", (F.col("id") * 0.5).alias("x"), F.lit(None).cast("string").alias("none"))
    spec = infer_spec(df)
    assert not any("none" in (a, b) for a, b, _ in spec["corr"])
    assert synthesize(spark, spec).agg(F.count("none"), F.count("x")).first() == (0, 60)
