"""Registry of named queries: a Spark callable (spark, sf_dir) → DataFrame and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PLACES = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def round_like_sql(c, places: int = PLACES):
    """``round(x * 10^p) / 10^p``: the same double as SQL engines that round the binary value.

    ``F.round(x, p)`` rounds the shortest decimal text half-up, which differs
    from binary rounding on ties such as 0.0499185.
    """
    m = float(10 ** places)
    return F.round(c * F.lit(m)) / F.lit(m)


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every double column so that last-digit float differences do not matter."""
    return df.select(*[round_like_sql(F.col(f.name), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def u_sql(seed: int, tag: str, key_sql: str) -> str:
    """DuckDB text of :func:`synthkit.functions.random.uniform` (md5 mode)."""
    return (f"(('0x' || substr(md5(concat_ws(':', '{seed}', '{tag}', CAST({key_sql} AS VARCHAR))), 1, 13))"
            f"::BIGINT / 4503599627370496.0)")


def normal_sql(seed: int, tag: str, key_sql: str) -> str:
    u1, u2 = u_sql(seed, tag + "#1", key_sql), u_sql(seed, tag + "#2", key_sql)
    return f"(sqrt(-2.0 * ln(1.0 - {u1})) * cos(2.0 * pi() * {u2}))"


def num_text_sql(x: str, places: int = 2) -> str:
    return f"regexp_replace(printf('%.{places}f', round({x}, {places})), '\\.?0+$', '')"
