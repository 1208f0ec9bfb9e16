"""Label sets: chances against all subsets, shares and lengths of the source kept together, odd inputs."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthkit.operators.labels import expected_shares, fit_chances, gen_label_sets, take_chances
from synthkit.operators.profile import fit_multilabel
from synthkit.operators.synth import synthesize
from synthkit.plans.spec import infer_spec


def test_chances_against_all_subsets():
    w = np.array([0.2, 3.0, 1.0, 0.5, 40.0])
    chances = take_chances(np.log(w), 4)
    for k in range(5):
        sets = list(combinations(range(5), k))
        weight = np.array([np.prod(w[list(s)]) for s in sets])
        want = [sum(x for s, x in zip(sets, weight) if i in s) / weight.sum() for i in range(5)]
        assert np.allclose(expected_shares(chances, np.eye(5)[k]), want)


@pytest.mark.parametrize("seed", range(6))
def test_the_fit_meets_the_shares_of_real_rows(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(2, 12))
    weight = rng.pareto(0.7, m) + 1e-3  # a few labels in most rows, some in hardly any
    sizes = rng.choice([0, 1, min(2, m), m // 2, m], 3000, p=[0.2, 0.4, 0.2, 0.15, 0.05])
    rows = np.zeros((3000, m))
    for r, k in enumerate(sizes):
        rows[r, rng.choice(m, k, replace=False, p=weight / weight.sum())] = 1
    hist = np.bincount(sizes, minlength=sizes.max() + 1) / 3000
    chances = fit_chances(list(rows.mean(axis=0)), [(k, s) for k, s in enumerate(hist) if s])
    assert np.abs(expected_shares(chances, hist) - rows.mean(axis=0)).max() < 1e-4


def test_rows_keep_lengths_and_shares_together(spark):
    u = [F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)) / 1000 for i in range(6)]
    # lengths far from those of independent labels: none, one, or four and more
    often = F.array(*[F.when(u[0] < 0.5, u[i] < 0.2 * i).otherwise(u[i] < 0.8) for i in range(1, 6)])
    src = spark.range(20000).select("id", F.filter(F.transform(F.arrays_zip(often.alias("t"), F.array(*[F.lit(c) for c in "vwxyz"]).alias("l")),
                                                               lambda e: F.when(e["t"], e["l"])), lambda x: x.isNotNull()).alias("tags"))
    spec = infer_spec(src, rows=20000, seed=3)
    assert {c["name"]: "lengths" in c["dist"] for c in spec["columns"]}["tags"]
    syn = synthesize(spark, spec)
    assert [r.tags for r in syn.orderBy("id").limit(5).collect()] == [r.tags for r in synthesize(spark, spec, num_partitions=3).orderBy("id").limit(5).collect()]
    (a_shares, a_lengths), (b_shares, b_lengths) = fit_multilabel(src, "tags"), fit_multilabel(syn, "tags")
    for a, b, key in ((a_shares, b_shares, "label"), (a_lengths, b_lengths, "labels")):
        want, got = ({r[key]: r["share"] for r in t.collect()} for t in (a, b))
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 0.015 for k in want), (want, got)
    assert syn.where(F.size(F.array_distinct("tags")) != F.size("tags")).isEmpty()


def test_odd_inputs(spark):
    ids = spark.range(50)
    empty = ids.select(gen_label_sets(1, "t", [], [(0, 1.0)]).alias("t"), gen_label_sets(1, "t", [("a", 0.5)], [(0, 1.0)]).alias("u"))
    assert {(tuple(r.t), tuple(r.u)) for r in empty.collect()} == {((), ())}
    every = ids.select(gen_label_sets(1, "t", [("a", 1.0), ("b", 1.0)], [(2, 1.0)]).alias("t")).collect()
    assert all(r.t == ["a", "b"] for r in every)
    with pytest.raises(ValueError):
        gen_label_sets(1, "t", [("a", 0.5)], [(2, 1.0)])


def test_export_manifest_counts_rows_and_bytes(spark, tmp_path):
    from synthkit.sources.sinks import export_manifest
    df = spark.range(1234).select("id", F.array("id").alias("list"))
    for fmt in ("csv", "parquet", "json"):
        path = tmp_path / fmt
        r = export_manifest(df.repartition(3), str(path), fmt).first()
        files = [f for f in path.iterdir() if f.name.startswith("part-")]
        assert (r["rows"], r["format"], r["files"], r["bytes"]) == (1234, fmt, len(files), sum(f.stat().st_size for f in files))
        assert r["summary"].startswith(f"1,234 rows · {fmt.upper()} · ")
    none = export_manifest(df.limit(0), str(tmp_path / "none"), "csv").first()
    assert none["rows"] == 0 and none["summary"].startswith("0 rows")
