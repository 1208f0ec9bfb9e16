"""nearest_source against brute force: dense clusters, ties, many columns, missing values, growth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthkit.operators import nearest, validate


def rows_of(rng, n, dims, kind):
    if kind == "clusters":  # nearly all points in two tiny clusters
        x = rng.normal(0, 1e-4, (n, dims)) + rng.integers(0, 2, (n, 1)) * 5
        x[: n // 50] = rng.normal(0, 50, (n // 50, dims))
    elif kind == "ties":  # few distinct values, one of them very frequent
        x = np.where(rng.random((n, dims)) < 0.7, 0.0, rng.integers(-3, 4, (n, dims))).astype(float)
    else:
        x = rng.normal(0, 1, (n, dims))
    return x


def frame(spark, x, key=False):
    names = [f"c{i}" for i in range(x.shape[1])]
    data = [(*([i] if key else []), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, ", ".join([*(["id long"] if key else []), *(f"{c} double" for c in names)])), names


@pytest.mark.parametrize("dims,kind", [(2, "clusters"), (1, "ties"), (6, "normal"), (4, "ties")])
def test_equal_to_brute_force(spark, dims, kind):
    rng = np.random.default_rng(dims)
    a, b = rows_of(rng, 700, dims, kind), rows_of(rng, 200, dims, kind)
    src, cols = frame(spark, a)
    syn, _ = frame(spark, b, key=True)
    got = {r.id: r.distance for r in validate.nearest_source(src, syn, cols, "id", leaf=16).collect()}
    sd = a.std(axis=0, ddof=1)
    want = np.sqrt((((b[:, None] - a[None]) / np.where(sd > 0, sd, 1)) ** 2).sum(axis=2).min(axis=1))
    assert len(got) == 200 and np.allclose([got[i] for i in range(200)], want, atol=1e-9)


def test_ends_without_complete_source_rows(spark):
    src = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, None), (None, 5.0)], "a double, b double")
    syn = spark.createDataFrame([(1, 1.0, 2.0)], "id long, a double, b double")
    found = validate.nearest_source(src, syn, ["a", "b"], "id")
    assert found.columns == ["id", "distance"] and found.count() == 0
    assert validate.nearest_source(syn.limit(0), syn, ["a", "b"], "id").count() == 0
    one = validate.nearest_source(src.unionByName(syn.select("a", "b")), syn.unionByName(syn), ["a", "b"], "id").collect()
    assert [tuple(r) for r in one] == [(1, 0.0), (1, 0.0)]


def test_compared_rows_grow_linearly_on_dense_clusters(spark):
    per_row = []
    for n in (1000, 10_000):
        rng = np.random.default_rng(n)
        src, cols = frame(spark, rows_of(rng, n, 2, "clusters"))
        syn, _ = frame(spark, rows_of(rng, n, 2, "clusters"), key=True)
        found = validate.nearest_source(src, syn, cols, "id", with_compared=True)
        per_row.append(found.selectExpr("sum(compared) / count(*)").first()[0])
    assert per_row[1] < 1.5 * per_row[0] < 600


def test_distances_of_few_columns_are_written_out(spark, monkeypatch):
    """Nested functions of arrays (zip_with, aggregate) run for every child and point of a query: most of the time at size."""
    rng = np.random.default_rng(9)
    src, cols = frame(spark, rows_of(rng, 600, 3, "clusters"))
    syn, _ = frame(spark, rows_of(rng, 200, 3, "clusters"), key=True)
    found = validate.nearest_source(src, syn, cols, "id", leaf=16)
    assert not any(f in found._jdf.queryExecution().optimizedPlan().toString() for f in ("zip_with", "zipwith", "aggregate(transform", "lambda v"))
    x, lo, hi = ([0.0, 3.0, -2.0], [-1.0, 0.0, 1.0], [1.0, 2.0, 4.0])
    one = spark.createDataFrame([(x, lo, hi)], "x array<double>, lo array<double>, hi array<double>")
    both = lambda: one.select(nearest._box_distance(F.col("x"), F.col("lo"), F.col("hi"), 3), nearest._distance(F.col("x"), F.col("lo"), 3)).first()
    few = tuple(both())
    monkeypatch.setattr(nearest, "_WRITTEN_OUT", 0)
    assert few == tuple(both()) == (10.0, 19.0)
    many = {r.id: r.distance for r in validate.nearest_source(src, syn, cols, "id", leaf=16).collect()}
    assert {r.id: r.distance for r in found.collect()} == many


@pytest.mark.parametrize("dims,kind", [(2, "clusters"), (1, "ties"), (3, "normal"), (5, "ties")])
def test_many_cells_and_parts_of_their_queries(spark, monkeypatch, dims, kind):
    monkeypatch.setattr(nearest.split_tree, "__defaults__", (40,))
    monkeypatch.setattr(nearest, "PART", 5)
    rng = np.random.default_rng(dims + 10)
    a, b = rows_of(rng, 1500, dims, kind), rows_of(rng, 300, dims, kind) * 1.3  # some lie outside all boxes
    src, cols = frame(spark, a)
    syn, _ = frame(spark, b, key=True)
    twice = syn.unionByName(syn.withColumn("id", F.when(F.col("id") < 100, F.col("id"))))  # keys that repeat, and null ones
    got = [(r.id, r.distance) for r in validate.nearest_source(src, twice, cols, "id", leaf=4).collect()]
    sd = a.std(axis=0, ddof=1)
    want = np.sqrt((((b[:, None] - a[None]) / np.where(sd > 0, sd, 1)) ** 2).sum(axis=2).min(axis=1))
    assert sorted(i for i, _ in got if i is not None) == sorted([*range(300), *range(100)])
    assert all(abs(d - want[i]) < 1e-9 for i, d in got if i is not None)
    assert np.allclose(sorted(d for i, d in got if i is None), sorted(want[100:]), atol=1e-9)


def test_a_cell_is_searched_in_one_task(spark):
    """A node, two walks and a list of points for every 32 rows took most of the time at size."""
    rng = np.random.default_rng(3)
    src, cols = frame(spark, rows_of(rng, 5000, 2, "normal"))
    levels, cells = nearest.split_tree(src.select(F.array(*cols).alias("x")), 2)
    assert levels == [] and cells.select("node").distinct().count() == 1
    syn, _ = frame(spark, rows_of(rng, 5000, 2, "normal"), key=True)
    assert validate.nearest_source(src, syn, cols, "id", with_compared=True).selectExpr("sum(compared) / count(*)").first()[0] < 150


@pytest.mark.parametrize("n,dims,leaf", [(1, 1, 32), (5, 3, 2), (33, 2, 32), (1000, 2, 7), (500, 8, 16)])
def test_search_of_a_cell(n, dims, leaf):
    rng = np.random.default_rng(n)
    points, queries = rows_of(rng, n, dims, "ties" if n == 500 else "normal"), rng.normal(0, 2, (9000 if n == 1000 else 50, dims))
    found, compared = nearest.search(queries, points, leaf)
    gaps = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert np.allclose(gaps[np.arange(len(queries)), found], gaps.min(axis=1)) and compared.max() <= n and compared.min() >= 1
