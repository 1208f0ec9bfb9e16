"""Conditional inverse sampling: precision, rare predicates in one pass, the same law as plain rejection."""

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from synthkit.operators import rules
from synthkit.operators.conditions import Given, bounds_of, truncated_normal, upper_normal
from synthkit.operators.synth import synthesize
from synthkit.plans.spec import COHORT_SPEC

LINKED = {"rows": 1, "seed": 3, "mode": "md5", "corr": [["a", "b", 0.8], ["b", "c", 0.3]], "corr_kind": "pearson", "columns": [
    {"name": n, "type": "float", "spark_type": "double", "dist": {"family": "gaussian", "mu": 10.0, "sigma": 2.0}} for n in "abc"]}


def ks(x, y):
    both = sorted([(v, 0) for v in x] + [(v, 1) for v in y])
    f, worst = [0, 0], 0.0
    for i, (v, side) in enumerate(both):
        f[side] += 1
        if i + 1 == len(both) or both[i + 1][0] != v:
            worst = max(worst, abs(f[0] / len(x) - f[1] / len(y)))
    return worst


def test_inverse_normal_and_tails(spark):
    ps = [1e-300, 1e-20, 1e-9, 1e-5, 0.01, 0.0749, 0.2, 0.5, 0.8, 0.93, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", upper_normal(F.col("p")).alias("z")).collect()
    for r in got:
        assert math.isclose(r.z, -NormalDist().inv_cdf(r.p), rel_tol=1e-12, abs_tol=1e-12)
    u = F.col("id") / 1000
    for lo, hi in ((-math.inf, math.inf), (8.0, math.inf), (-math.inf, -9.0), (-0.3, 1.2), (6.0, 6.1)):
        r = spark.range(1000).select(truncated_normal(u, lo, hi).alias("z")).agg(F.min("z"), F.max("z"), F.count("z"), F.count_distinct("z")).first()
        assert lo <= r[0] <= r[1] <= hi and r[2] == r[3] == 1000


def test_only_simple_conjunctions_are_taken():
    assert bounds_of("a > 1 AND `b` <= -2.5e3 and s = 'x y' AND size(l) >= 3") == {"a": [(">", 1.0)], "b": [("<=", -2500.0)], "s": [("=", "x y")]}
    for text in ("a > 1 OR b < 2", "NOT a > 1", "a BETWEEN 1 AND 2", "CASE WHEN a > 1 THEN b > 1 END", "s = 'x and y' AND a > 1"):
        assert bounds_of(text) == {}


def test_one_in_a_billion_in_one_pass(spark):
    where = f"hba1c > {math.exp(1.9 + 0.3 * 6)} AND age < 70"
    rows, report = rules.edge_cases(spark, COHORT_SPEC, where, 500)
    assert report["shortfall"] == 0 and report["candidates"] == 10_000 and report["chance"] < 1e-9
    got = rows.collect()
    assert len(got) == 500 == len({r.id for r in got}) and all(math.log(r.hba1c) > 3.7 - 1e-12 and r.age < 70 for r in got)
    excess = [(math.log(r.hba1c) - 1.9) / 0.3 - 6 for r in got]  # about exponential with mean 1 / 6.16
    assert abs(sum(excess) / 500 * 6.16 - 1) < 0.15


def test_same_law_as_plain_rejection(spark):
    where = "hba1c > 7 AND age >= 55 AND last_visit >= '2024-03-01' AND sex = 'F' AND size(comorbidities) >= 1"
    plain = synthesize(spark, {**COHORT_SPEC, "seed": 99}, rows=60_000).filter(where).collect()
    rows, report = rules.edge_cases(spark, COHORT_SPEC, where, 3000)
    got = rows.collect()
    assert len(got) == 3000 and report["acceptance"] > 0.5 > 10 * len(plain) / 60_000 / 2
    for value in (lambda r: r.hba1c, lambda r: r.age, lambda r: r.last_visit, lambda r: len(r.comorbidities)):
        assert ks([value(r) for r in plain], [value(r) for r in got]) < 1.7 * math.sqrt(1 / len(plain) + 1 / len(got))


def test_linked_columns_follow(spark):
    rows, report = rules.edge_cases(spark, LINKED, "b > 23 AND c > 9", 1000)
    got = rows.collect()
    assert report["shortfall"] == 0 and len(got) == 1000 and report["candidates"] <= 20_000
    z = sum((r.b - 10) / 2 for r in got) / 1000
    assert z > 6.5 and abs(sum((r.a - 10) / 2 for r in got) / 1000 - 0.8 * z) < 0.1
    plain = synthesize(spark, {**LINKED, "seed": 8}, rows=30_000).filter("a > 11 AND b < 12").collect()
    rows, _ = rules.edge_cases(spark, LINKED, "a > 11 AND b < 12", 2000)
    got = rows.collect()
    for n in "abc":
        assert ks([r[n] for r in plain], [r[n] for r in got]) < 1.7 * math.sqrt(1 / len(plain) + 1 / 2000)


def test_impossible_predicates_end(spark):
    rows, report = rules.edge_cases(spark, COHORT_SPEC, "age > 50 AND age < 40", 10)
    assert rows.count() == 0 and report["candidates"] == 0 and report["shortfall"] == 10
    rows, report = rules.edge_cases(spark, COHORT_SPEC, "size(comorbidities) > 4", 10, max_candidates=30_000)
    assert rows.count() == 0 and report["candidates"] == 30_000 and report["shortfall"] == 10
    assert Given(COHORT_SPEC, "sex = 'F'").chance == 0.52
