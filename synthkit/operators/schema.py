"""The product's schema table (column, type, distribution, sample) and multi-source alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.functions.random import uniform
from synthkit.functions.text import shorten, slugify
from synthkit.operators.distinct import Cardinality
from synthkit.operators.ordering import written
from synthkit.operators.profile import (
    fit_best, infer_types, num_text, value_counts,
)


def _epoch_to_date_text(x: Column) -> Column:
    return F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd")


def dist_text(fits: DataFrame) -> Column:
    """Fitted parameters → distribution text.

    Needs columns type, family, mu, sigma, mu_log, sigma_log, rate, lo, hi,
    is_unique and shares_text.  Formats (fixed values): ``unique``,
    ``Gaussian (μ=52, σ=8)``, ``{F:0.52, M:0.48}``, ``LogNormal (μ=1.9, σ=0.3)``
    (σ added by us), ``Multi-label``, ``Uniform 2023-2025`` for dates;
    ``Uniform (a, b)``, ``Exponential (λ=r)``, ``Text``, ``JSON`` are ours.
    """
    fam = F.col("family")
    num = (F.when(fam == "gaussian", F.format_string("Gaussian (μ=%s, σ=%s)", num_text(F.col("mu")),
                                                      num_text(F.col("sigma"))))
           .when(fam == "lognormal", F.format_string("LogNormal (μ=%s, σ=%s)", num_text(F.col("mu_log")),
                                                      num_text(F.col("sigma_log"))))
           .when(fam == "uniform", F.format_string("Uniform (%s, %s)", num_text(F.col("lo")),
                                                    num_text(F.col("hi"))))
           .when(fam == "exponential", F.format_string("Exponential (λ=%s)", num_text(F.col("rate"), 4))))
    date = (F.when(fam == "uniform", F.format_string(
                "Uniform %s-%s", F.year(F.timestamp_seconds(F.col("lo"))).cast("string"),
                F.year(F.timestamp_seconds(F.col("hi"))).cast("string")))
            .when(fam == "gaussian", F.format_string("Gaussian (μ=%s, σ=%s days)",
                                                     _epoch_to_date_text(F.col("mu")),
                                                     num_text(F.col("sigma") / 86400.0, 1)))
            .otherwise(F.format_string("%s from %s", F.initcap(fam), _epoch_to_date_text(F.col("lo")))))
    t = F.col("type")
    return (F.when(F.col("is_unique") & t.isin("uuid", "int", "text"), F.lit("unique"))
            .when(t == "enum", F.col("shares_text"))
            .when(t.isin("int", "float"), num)
            .when(t == "date", date)
            .when(t == "array<str>", F.lit("Multi-label"))
            .when(t == "text", F.lit("Text"))
            .otherwise(F.lit("JSON")))


def _sample(seed: int) -> Column:
    return F.min_by("v", uniform(seed, "sample_value", F.col("v"))).alias("_v")


def profile_table(df: DataFrame, seed: int = 0, enum_max: int = 50, min_rate: float = 0.99,
                  share_places: int = 2) -> DataFrame:
    """Everything needed for the schema table and the synthesis spec, one row per column.

    Jobs: one scan of sketches (:mod:`synthkit.operators.distinct`), exact digests for the columns near a limit,
    one aggregate for the fits, one for the samples; only the values of columns that may be enums are written.
    Columns: column, spark_type, type, n, nulls, distinct (exact for enum and near-unique columns, else the
    sketch's estimate), is_unique, family, fit parameters, shares (array<struct<value,share>>), shares_text and sample.
    """
    gate = Cardinality(df, enum_max=enum_max)
    stats = gate.table(df.sparkSession)
    few = gate.few
    vc = written(value_counts(df, few), "values") if few else df.sparkSession.createDataFrame([], "column string, v string, cnt bigint")
    types = infer_types(df, min_rate=min_rate, enum_max=enum_max, stats=stats)
    fit_cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                           T.FloatType, T.DoubleType, T.DecimalType, T.DateType,
                                           T.TimestampType, T.TimestampNTZType))]
    base = types.join(stats.select("column", "n", "nulls", "distinct"), "column")
    base = base.withColumn("is_unique", (F.col("distinct") == F.col("n")) & (F.col("n") > enum_max))
    if fit_cols:
        base = base.join(fit_best(df, fit_cols).drop("n"), "column", "left")
    else:
        for c in ("family", "mu", "sigma", "rate", "lo", "hi", "mu_log", "sigma_log", "aic"):
            base = base.withColumn(c, F.lit(None).cast("string" if c == "family" else "double"))
    # enum shares: only enum columns (≤ enum_max values each) are collected into arrays
    enum_cols = base.filter(F.col("type") == "enum").select("column", "n")
    shares = (vc.join(F.broadcast(enum_cols), "column")
              .withColumn("share", F.col("cnt") / F.col("n"))
              .groupBy("column")
              .agg(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("k"), F.col("v").alias("value"),
                                                        F.col("share")))).alias("_sh")))
    shares = shares.select(
        "column",
        F.transform("_sh", lambda s: F.struct(s["value"].alias("value"), s["share"].alias("share"))).alias("shares"),
        F.concat(F.lit("{"), F.array_join(F.transform("_sh", lambda s: F.concat(
            s["value"], F.lit(":"), num_text(s["share"], share_places))), ", "), F.lit("}")).alias("shares_text"))
    # the value of the smallest hash: the same over all rows as over the distinct values
    samples = vc.groupBy("column").agg(_sample(seed))
    many = [c for c in df.columns if c not in few]
    if many:
        values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in many])).alias("e"))
        samples = samples.unionByName(values.select("e.*").where("v IS NOT NULL").groupBy("column").agg(_sample(seed)))
    out = base.join(shares, "column", "left").join(samples, "column", "left")
    t = F.col("type")
    sample = (F.when(t == "uuid", shorten(F.col("_v"), 5, 2))
              .when(t == "float", num_text(F.col("_v").cast("double"), 2))
              .when(t == "date", F.substring(F.col("_v"), 1, 10))
              .otherwise(F.col("_v")))
    return out.withColumn("sample", sample).drop("_v")


def infer_schema(df: DataFrame, seed: int = 0, enum_max: int = 50, min_rate: float = 0.99) -> DataFrame:
    """The product's schema table: ``(column, type, distribution, sample)``."""
    p = profile_table(df, seed=seed, enum_max=enum_max, min_rate=min_rate)
    return p.select("column", "type", dist_text(p).alias("distribution"), "sample")


def align_schemas(sources: dict[str, DataFrame], enum_max: int = 50, strip: str | None = None) -> DataFrame:
    """Column signatures across sources, matched on the slugified column name.

    → ``(column, sources, types, n_sources, conflict)``: which sources have the
    column, the set of inferred types and whether they disagree.  ``strip`` is
    an optional regex removed from names first (e.g. a table prefix).  Each source
    is profiled once (a fixed number of jobs per source, not per column).
    """
    sigs = []
    for name, df in sources.items():
        t = infer_types(df, enum_max=enum_max)
        name_col = F.regexp_replace(F.col("column"), strip, "") if strip else F.col("column")
        sigs.append(t.select(slugify(name_col).alias("column"),
                             F.lit(name).alias("source"), F.col("type")))
    allsig = reduce(lambda a, b: a.unionByName(b), sigs)
    return (allsig.groupBy("column")
            .agg(F.sort_array(F.collect_set("source")).alias("sources"),
                 F.sort_array(F.collect_set("type")).alias("types"))
            .withColumn("n_sources", F.size("sources"))
            .withColumn("conflict", F.size("types") > 1))


def merge_sources(sources: dict[str, DataFrame], rename: dict[str, dict[str, str]] | None = None,
                  source_col: str = "source") -> DataFrame:
    """One dataset from many: rename per source, union by name (missing → null), tag the source.

    Numeric columns that differ in type between sources are widened by Spark's
    union type coercion (int + bigint → bigint, int + double → double).
    """
    rename = rename or {}
    parts = []
    for name, df in sources.items():
        m = rename.get(name, {})
        parts.append(df.select(*[F.col(c).alias(m.get(c, c)) for c in df.columns])
                     .withColumn(source_col, F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
