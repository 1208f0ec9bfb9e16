"""Distinct counts behind a gate of sketches: exact where a decision hangs on them, without a text copy of the values.

One scan builds a HyperLogLog sketch of every column (mergeable, a few KB).  Types need two facts only: whether a
column has few values (an enum) and whether no value repeats (unique).  Columns whose estimate is near the enum limit
or below are counted by value; columns whose estimate is near their row count are counted by fixed-width digests.
All others are far from both limits (a sketch is off by 1.6 % as a rule, the gate leaves tens of such deviations at
the enum limit and six at the row count), so their estimate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_UNIQUE = 0.9  # share of the rows from which a column is counted exactly


def _digest(c: str) -> Column:
    """128 bits of the value's text: two hashes of unlike seeds."""
    v = F.col(f"`{c}`").cast("string")
    return F.struct(F.lit(c).alias("column"), F.xxhash64(v).alias("a"), F.xxhash64(F.lit("second"), v).alias("b"), v.isNull().alias("z"))


def digest_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, n, distinct)`` of non-null values, exact: 16 bytes a distinct value are shuffled, whatever its length."""
    rows = df.select(F.explode(F.array(*[_digest(c) for c in cols])).alias("e")).select("e.*").where("NOT z")
    values = rows.groupBy("column", "a", "b").agg(F.count(F.lit(1)).alias("cnt"))
    return values.groupBy("column").agg(F.sum("cnt").cast("bigint").alias("n"), F.count(F.lit(1)).alias("distinct"))


class Cardinality:
    """What the gate found: ``rows`` of (column, n, nulls, distinct) and the columns with ``few`` values."""

    def __init__(self, df: DataFrame, cols: list[str] | None = None, enum_max: int = 50):
        cols = list(cols or df.columns)
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(cols):
            text = F.xxhash64(F.col(f"`{c}`").cast("string"))
            aggs += [F.count(F.col(f"`{c}`")).alias(f"n{i}"),
                     F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(f"`{c}`").isNotNull(), text))).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        n = {c: row[f"n{i}"] for i, c in enumerate(cols)}
        about = {c: row[f"d{i}"] or 0 for i, c in enumerate(cols)}
        self.few = [c for c in cols if about[c] <= 2 * enum_max + 16]
        near = [c for c in cols if c not in self.few and about[c] >= NEAR_UNIQUE * n[c]]
        exact = {r["column"]: r["distinct"] for r in digest_counts(df, self.few + near).collect()} if self.few or near else {}
        self.exact = set(self.few + near)
        self.rows = [(c, n[c], row["rows"] - n[c], exact.get(c, 0) if c in self.exact else min(max(about[c], enum_max + 1), n[c] - 1))
                     for c in cols]

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "column string, n bigint, nulls bigint, distinct bigint")  # one row a column
