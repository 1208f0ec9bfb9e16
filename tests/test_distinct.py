"""The distinct gate: types stay exact beside their limits, estimates serve elsewhere, few bytes are written."""

import os

import pytest
from pyspark.sql import functions as F

from synthkit.operators.distinct import Cardinality, digest_counts
from synthkit.operators.profile import infer_types, unique_columns
from synthkit.operators.schema import infer_schema, profile_table


@pytest.fixture(scope="module")
def odd(spark):
    """Values at and beside each limit: 50 and 51 values, one repeat in a unique column, nulls, long texts."""
    i = F.col("id")
    token = F.concat(F.lit("t"), F.md5(i.cast("string")))
    return spark.range(20000).select(
        (i % 50).alias("fifty"), (i % 51).alias("fiftyone"), token.alias("unique"), F.when(i != 7, token).alias("unique_null"),
        F.when(i == 9, F.concat(F.lit("t"), F.md5(F.lit("8")))).otherwise(token).alias("one_repeat"), F.lit(None).cast("string").alias("empty"),
        (i % 5000).cast("string").alias("middle"), F.concat(F.repeat(F.lit("x y "), 50), i.cast("string")).alias("long"), (i * 3).alias("key"))


def test_types_at_their_limits(odd):
    got = {r["column"]: r["type"] for r in infer_types(odd).collect()}
    assert got == {"fifty": "enum", "fiftyone": "int", "unique": "uuid", "unique_null": "uuid", "one_repeat": "text", "empty": "enum",
                   "middle": "int", "long": "text", "key": "int"}
    unique = {r["column"]: r["is_unique"] for r in profile_table(odd).collect()}
    assert {c for c, u in unique.items() if u} == {"unique", "unique_null", "long", "key"}


def test_counts_are_exact_where_they_decide(odd):
    gate = Cardinality(odd)
    rows = {r[0]: r[1:] for r in gate.rows}
    assert gate.few == ["fifty", "fiftyone", "empty"] and "middle" not in gate.exact
    assert rows["unique_null"] == (19999, 1, 19999) and rows["one_repeat"] == (20000, 0, 19999) and rows["empty"] == (0, 20000, 0)
    assert abs(rows["middle"][2] / 5000 - 1) < 0.1
    assert {r["column"]: r["distinct"] for r in digest_counts(odd, ["middle", "long"]).collect()} == {"middle": 5000, "long": 20000}
    assert {r["column"]: r["is_unique"] for r in unique_columns(odd, ["key", "middle"]).collect()} == {"key": True, "middle": False}


def test_no_rows(odd):
    assert {r[3] for r in Cardinality(odd.limit(0)).rows} == {0}
    assert infer_schema(odd.limit(0)).count() == 9


def test_infer_schema_writes_little(spark, monkeypatch):
    from synthkit.operators import ordering
    paths = []
    plain = ordering.scratch_dir
    monkeypatch.setattr(ordering, "scratch_dir", lambda *a: paths.append(plain(*a)) or paths[-1])
    source = "/root/testdata/sf0.01/lineitem.parquet"
    assert infer_schema(spark.read.parquet(source)).count() > 0
    files = [os.path.join(d, f) for p in paths for d, _, names in os.walk(p.removeprefix("file:")) for f in names]
    size = sum(map(os.path.getsize, files))
    whole = os.path.getsize(source) if os.path.isfile(source) else sum(os.path.getsize(os.path.join(source, f)) for f in os.listdir(source))
    assert files and size < 0.05 * whole
