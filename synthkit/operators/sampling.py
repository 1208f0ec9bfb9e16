"""Repeatable sampling of source tables.

All draws are hash uniforms of (seed, tag, key) — see
:mod:`synthkit.functions.random` — so a sample is the same for any
partitioning and survives task retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthkit.functions.random import uniform
from synthkit.functions.text import shorten as _shorten


def hash_sample(df: DataFrame, key: str, rate: float, seed: int = 0, mode: str = "md5") -> DataFrame:
    """Bernoulli sample at ``rate``: a narrow filter, no shuffle."""
    return df.filter(uniform(seed, "sample", F.col(key), mode) < F.lit(float(rate)))


def stratified_sample(df: DataFrame, by: list[str] | str, n: int, key: str, seed: int = 0,
                      mode: str = "md5", salt_buckets: int = 64) -> DataFrame:
    """Up to ``n`` rows per stratum: those with the smallest hash uniform.

    A stratum may hold most of the table, so the per-stratum top-n runs in two
    steps: first inside (stratum, salt) sub-groups, then over the at most
    ``n * salt_buckets`` survivors of each stratum.  Rare strata keep all rows.
    """
    by = [by] if isinstance(by, str) else list(by)
    u = uniform(seed, "strata", F.col(key), mode)
    base = df.withColumn("_sk_u", u).withColumn(
        "_sk_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(salt_buckets)))
    order = [F.col("_sk_u"), F.col(key)]
    w1 = Window.partitionBy(*by, "_sk_salt").orderBy(*order)
    step1 = base.withColumn("_sk_rn", F.row_number().over(w1)).filter(F.col("_sk_rn") <= n)
    w2 = Window.partitionBy(*by).orderBy(*order)
    step2 = step1.withColumn("_sk_rn", F.row_number().over(w2)).filter(F.col("_sk_rn") <= n)
    return step2.drop("_sk_u", "_sk_salt", "_sk_rn")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0, mode: str = "md5") -> DataFrame:
    """Exactly ``min(n, rows)`` rows with the smallest hash uniform (TakeOrderedAndProject)."""
    return (df.withColumn("_sk_u", uniform(seed, "sample_n", F.col(key), mode))
            .orderBy("_sk_u", key).limit(n).drop("_sk_u"))


def sample_value(df: DataFrame, cols: list[str] | None = None, seed: int = 0) -> DataFrame:
    """One sample value (as text) per column, all columns in one aggregate.

    The chosen value is the non-null value whose own hash uniform is smallest:
    repeatable, independent of row order and partitioning.
    """
    cols = cols or df.columns
    structs = []
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("string")
        aggs.append(F.min_by(v, F.when(v.isNotNull(), uniform(seed, "sample_value", v))).alias(f"_s{i}"))
        structs.append(F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sample")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def shorten(df: DataFrame, col: str, head: int = 5, tail: int = 2, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, _shorten(col, head, tail))
