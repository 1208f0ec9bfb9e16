"""Schema inference and distribution fitting (one pass per report, long form for distincts).

Design rules used throughout:

* all per-column moments come from ONE aggregate (chunked at ``_CHUNK``
  columns so generated code stays under the 64 KB method limit) and are
  unpivoted with ``inline`` — never one job per column;
* types need exact distinct counts only near their limits: sketches in one scan
  tell which columns these are, and fixed-width digests count them;
* category shares come from a long-form value-count table ``(column, v, cnt)``
  built with a partial (map-side) aggregate, so a hot value collapses before
  the shuffle;
* nothing collects rows; only per-column parameters are small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.functions.random import uniform
from synthkit.operators.brackets import exact_quantiles
from synthkit.operators.cross import pair_moments
from synthkit.operators.distinct import Cardinality, digest_counts
from synthkit.operators.ordering import with_running_sums
from synthkit.operators.ranks import rank_products

_CHUNK = 100
_AGGS_PER_PLAN = 24  # keep each aggregate's generated code small enough for whole-stage codegen
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)

# The product's six column types (plus our 'text' and 'json').
TYPES = ("uuid", "int", "enum", "float", "array<str>", "date")
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _is(dt, kinds) -> bool:
    return isinstance(dt, kinds)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if _is(f.dataType, _NUMERIC)]


def _as_double(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if _is(dt, T.DateType):
        return F.unix_date(F.col(c)).cast("double")
    if _is(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double") / F.lit(1e6)
    if _is(dt, T.BooleanType):
        return F.col(c).cast("int").cast("double")
    return F.col(c).cast("double")


def num_text(x: Column, places: int = 2) -> Column:
    """Short number text: round, ``%.Nf``, drop trailing zeros (52.00 → 52, 1.90 → 1.9)."""
    return F.regexp_replace(F.format_string(f"%.{places}f", F.round(x, places)), r"\.?0+$", "")


def _chunks(items: list, n: int = _CHUNK):
    for i in range(0, len(items), n):
        yield items[i:i + n]


def _one_row_unpivot(df: DataFrame, specs: dict[str, list[tuple[str, Column, str]]]) -> DataFrame:
    """``specs``: column name → [(stat, agg Column, sql type)].  One agg per chunk, then inline."""
    names = list(specs)
    per = max(1, max(len(v) for v in specs.values()))
    out = None
    for chunk in _chunks(names, max(1, _AGGS_PER_PLAN // per)):
        aggs, structs = [], []
        for i, name in enumerate(chunk):
            fields = [F.lit(name).alias("column")]
            for stat, expr, typ in specs[name]:
                alias = f"_c{i}__{stat}"
                aggs.append(expr.alias(alias))
                fields.append(F.col(alias).cast(typ).alias(stat))
            structs.append(F.struct(*fields))
        part = df.agg(*aggs).select(F.inline(F.array(*structs)))
        out = part if out is None else out.unionByName(part)
    return out


def _per_column(df: DataFrame, cols: list[str], entry, aggs: list[Column]) -> DataFrame:
    """The same aggregates for every column in ONE scan: (column, ...) entries, grouped by column.

    The entries of a row exist in memory only; a map task sends one partial row
    per column.  The plan and its generated code do not grow with the columns.
    Columns without rows are listed with nulls.
    """
    long = df.select(F.explode(F.array(*[entry(c) for c in cols])).alias("_e")).select("_e.*")
    every = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    return every.join(long.groupBy("column").agg(*aggs), "column", "left")


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long form ``(column, v, cnt)``: one row per distinct non-null value of each column.

    Values are compared as text (``cast(... as string)``).  The explode is
    narrow; the aggregate is partial before the shuffle.
    """
    cols = cols or df.columns
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                    for c in cols])
    return (df.select(F.explode(arr).alias("_e")).select("_e.column", "_e.v")
            .filter(F.col("v").isNotNull())
            .groupBy("column", "v").agg(F.count(F.lit(1)).alias("cnt")))


def exact_mean(x: Column) -> Column:
    """Mean from an exact decimal sum; null where the values do not fit."""
    exact = x.try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double") / F.count(x))


def column_stats(df: DataFrame, cols: list[str] | None = None,
                 exact_distinct: bool = True) -> DataFrame:
    """Row per column: n, nulls, distinct, and for numbers min/max/mean/stddev/skewness/kurtosis.

    The mean is an exact decimal sum (10 places) divided once, so it does not
    depend on the order of rows; values too large for that use the double sum.

    ``exact_distinct=False`` uses ``approx_count_distinct`` (HLL, bounded memory)
    instead of the exact count of the values' digests.
    """
    cols = cols or df.columns

    def entry(c):
        x = F.col(c).cast("double") if _is(df.schema[c].dataType, _NUMERIC) else F.lit(None).cast("double")
        h = [] if exact_distinct else [F.xxhash64(F.col(c)).alias("h")]
        return F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("z"), x.alias("x"), *h)

    aggs = [F.count_if(~F.col("z")).alias("n"), F.count_if("z").alias("nulls"), F.min("x").alias("min"), F.max("x").alias("max"),
            F.coalesce(exact_mean(F.col("x")), F.avg("x")).alias("mean")]
    aggs += [fn("x").alias(k) for k, fn in (("stddev", F.stddev), ("skewness", F.skewness), ("kurtosis", F.kurtosis))]
    if not exact_distinct:
        aggs.append(F.approx_count_distinct(F.when(~F.col("z"), F.col("h"))).alias("distinct"))
    stats = _per_column(df, cols, entry, aggs)
    if exact_distinct:
        stats = stats.join(digest_counts(df, cols).drop("n"), "column", "left")
    counts = [F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias(k) for k in ("n", "nulls", "distinct")]
    return stats.select("column", *counts, "min", "max", "mean", "stddev", "skewness", "kurtosis")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n, nulls) of every column in one scan."""
    out = _per_column(df, df.columns, lambda c: F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("z")),
                      [F.count_if(~F.col("z")).alias("n"), F.count_if("z").alias("nulls")])
    return out.fillna(0, ["n", "nulls"])


def infer_types(df: DataFrame, min_rate: float = 0.99, enum_max: int = 50,
                stats: DataFrame | None = None) -> DataFrame:
    """``(column, spark_type, type)`` for every column.

    Typed columns use their Spark type plus cardinality; strings use parse
    rates (``try_cast`` counts in one aggregate): int, float, date, uuid
    pattern, then enum (≤ ``enum_max`` distinct), unique token-like text →
    uuid, otherwise ``text`` (ours).  Non-string arrays, maps, structs →
    ``json`` (ours).
    """
    stats = stats if stats is not None else Cardinality(df, enum_max=enum_max).table(df.sparkSession)

    def entry(c):
        text = F.col(c) if _is(df.schema[c].dataType, T.StringType) else F.lit(None).cast("string")
        return F.struct(F.lit(c).alias("column"), text.alias("v"))

    ok = {"has_space": F.col("v").rlike(r"\s"), "ok_int": F.col("v").try_cast("bigint").isNotNull(),
          "ok_float": F.col("v").try_cast("double").isNotNull(), "ok_date": F.col("v").try_cast("date").isNotNull(),
          "ok_uuid": F.col("v").rlike(UUID_PATTERN)}
    parse = _per_column(df, df.columns, entry, [F.max(F.length("v")).cast("bigint").alias("len_max"),
                                                *[F.count_if(c).alias(k) for k, c in ok.items()]])
    kinds = []
    for f in df.schema.fields:
        dt = f.dataType
        if _is(dt, T.StringType):
            k = "string"
        elif _is(dt, T.BooleanType):
            k = "bool"
        elif _is(dt, _INTEGRAL):
            k = "integral"
        elif _is(dt, _NUMERIC):
            k = "floating"
        elif _is(dt, _TIME):
            k = "time"
        elif _is(dt, T.ArrayType) and _is(dt.elementType, T.StringType):
            k = "labels"
        else:
            k = "other"
        kinds.append(F.struct(F.lit(f.name).alias("column"), F.lit(dt.simpleString()).alias("spark_type"),
                              F.lit(k).alias("kind")))
    spark = df.sparkSession
    kind_df = spark.range(1).select(F.inline(F.array(*kinds)))
    t = kind_df.join(stats.select("column", "n", "distinct"), "column").join(parse, "column")
    n = F.greatest(F.col("n"), F.lit(1))
    rate = lambda k: F.col(k) / n
    unique = (F.col("distinct") == F.col("n")) & (F.col("n") > F.lit(enum_max))
    small = F.col("distinct") <= F.lit(enum_max)
    string_type = (F.when(rate("ok_uuid") >= min_rate, "uuid")
                   .when(rate("ok_int") >= min_rate, F.when(small, "enum").otherwise("int"))
                   .when(rate("ok_float") >= min_rate, "float")
                   .when(rate("ok_date") >= min_rate, "date")
                   .when(small, "enum")
                   .when(unique & (F.col("has_space") == 0) & (F.col("len_max") <= 64), "uuid")
                   .otherwise("text"))
    typ = (F.when(F.col("kind") == "string", string_type)
           .when(F.col("kind") == "bool", "enum")
           .when(F.col("kind") == "integral", F.when(small, "enum").otherwise("int"))
           .when(F.col("kind") == "floating", "float")
           .when(F.col("kind") == "time", "date")
           .when(F.col("kind") == "labels", "array<str>")
           .otherwise("json"))
    return t.select("column", "spark_type", typ.alias("type"))


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact ``quantile_cont`` per column and prob → ``(column, prob, value)``.

    Exact at any size and without ordering all values: sketches bracket the wanted ranks, a second scan
    counts and selects inside the brackets (:mod:`synthkit.operators.brackets`).  Nulls and NaN are left
    out; a column without values gives no rows.  Both scans run in this call.
    """
    found = exact_quantiles(df, {c: _as_double(df, c) for c in cols}, probs)
    return df.sparkSession.createDataFrame(found, "column string, prob double, value double")  # columns x probs rows


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equi-width bins over [lo, hi] (data min/max when not given) → (bin, lo, hi, count)."""
    x = _as_double(df, col)
    base = df.select(x.alias("x")).filter(F.col("x").isNotNull())
    bounds = base.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo_c = F.lit(float(lo)) if lo is not None else bounds.select("lo").scalar()
    hi_c = F.lit(float(hi)) if hi is not None else bounds.select("hi").scalar()
    width = (hi_c - lo_c) / F.lit(bins)
    b = F.least(F.greatest(F.floor((F.col("x") - lo_c) / width) + 1, F.lit(1)), F.lit(bins))
    b = F.when(hi_c == lo_c, F.lit(1)).otherwise(b)
    return (base.filter((F.col("x") >= lo_c) & (F.col("x") <= hi_c))
            .groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (lo_c + (F.col("bin") - 1) * width).alias("lo"),
                    (lo_c + F.col("bin") * width).alias("hi"), "count"))


def category_shares(df: DataFrame, col: str) -> DataFrame:
    """``(value, count, share)`` over non-null values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")) \
        .agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("share", F.col("count") / total)


def entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """Shannon entropy (bits) and category count per column, from the long-form counts."""
    c = F.col("cnt").cast("double")  # log2 N - (sum of c log2 c) / N: one aggregate, no totals needed first
    return (value_counts(df, cols).groupBy("column")
            .agg((F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)).alias("entropy"),
                 F.count(F.lit(1)).alias("categories")))


# ---------------------------------------------------------------- fitting

FAMILIES = ("gaussian", "lognormal", "uniform", "exponential")


def moment_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column the closed-form sufficient statistics of every family, one aggregate."""
    x, pos = F.col("x"), F.when(F.col("x") > 0, F.col("x"))
    stats = {"n": F.count(x), "sx": F.sum(x), "sxx": F.sum(x * x), "mean": F.avg(x), "sd": F.stddev(x), "var_pop": F.var_pop(x),
             "n_pos": F.count(pos), "n_neg": F.count_if(x < 0), "sl": F.sum(F.log(pos)), "ml": F.avg(F.log(pos)),
             "sdl": F.stddev(F.log(pos)), "vl_pop": F.var_pop(F.log(pos)), "lo": F.min(x), "hi": F.max(x)}
    out = _per_column(df, cols, lambda c: F.struct(F.lit(c).alias("column"), _as_double(df, c).alias("x")),
                      [c.alias(k) for k, c in stats.items()])
    return out.fillna(0, ["n", "n_pos", "n_neg"])


def fit_best(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fit gaussian, lognormal, uniform and exponential by maximum likelihood; keep min AIC.

    Returns ``(column, family, aic, mu, sigma, rate, lo, hi, mu_log, sigma_log, n)``
    plus ``aic_<family>`` for every family.  Lognormal needs all x > 0,
    exponential all x ≥ 0; otherwise their AIC is null.
    """
    m = moment_sums(df, cols)
    n = F.col("n").cast("double")
    two_pi = F.lit(2 * math.pi)
    aic_g = F.lit(4.0) + n * (F.log(two_pi * F.col("var_pop")) + 1)
    aic_l = F.when(F.col("n_pos") == F.col("n"),
                   F.lit(4.0) + 2 * F.col("sl") + n * (F.log(two_pi * F.col("vl_pop")) + 1))
    aic_u = F.when(F.col("hi") > F.col("lo"), F.lit(4.0) + 2 * n * F.log(F.col("hi") - F.col("lo")))
    rate = F.when(F.col("mean") != 0, F.lit(1.0) / F.col("mean"))
    aic_e = F.when((F.col("n_neg") == 0) & (F.col("mean") > 0),
                   F.lit(2.0) - 2 * n * F.log(rate) + 2 * n)
    m = (m.withColumn("aic_gaussian", aic_g).withColumn("aic_lognormal", aic_l)
         .withColumn("aic_uniform", aic_u).withColumn("aic_exponential", aic_e))
    cand = F.array(*[F.struct(F.col("aic_" + f).alias("aic"), F.lit(f).alias("family"))
                     for f in FAMILIES])
    best = F.array_min(F.filter(cand, lambda s: s["aic"].isNotNull() & ~F.isnan(s["aic"])))
    return m.select(
        "column", best["family"].alias("family"), best["aic"].alias("aic"),
        F.col("mean").alias("mu"), F.col("sd").alias("sigma"), rate.alias("rate"), "lo", "hi",
        F.col("ml").alias("mu_log"), F.col("sdl").alias("sigma_log"), "n",
        *[F.col("aic_" + f) for f in FAMILIES])


def fit_gaussian(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg(col).alias("mu"), F.stddev(col).alias("sigma"), F.count(col).alias("n"))


def fit_lognormal(df: DataFrame, col: str) -> DataFrame:
    pos = F.when(F.col(col) > 0, F.col(col))
    return df.agg(F.avg(F.log(pos)).alias("mu_log"), F.stddev(F.log(pos)).alias("sigma_log"),
                  F.count(pos).alias("n"), (F.count_if(F.col(col) <= 0) / F.count(col)).alias("share_nonpos"))


def fit_uniform(df: DataFrame, col: str) -> DataFrame:
    x = _as_double(df, col)
    out = [F.min(x).alias("lo"), F.max(x).alias("hi")]
    if _is(df.schema[col].dataType, _TIME):
        out += [F.year(F.min(col)).alias("year_lo"), F.year(F.max(col)).alias("year_hi")]
    return df.agg(*out)


def fit_exponential(df: DataFrame, col: str) -> DataFrame:
    return df.agg((F.lit(1.0) / F.avg(col)).alias("rate"), F.count(col).alias("n"))


def fit_multilabel(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Label shares (share of non-null rows holding the label) and the labels-per-row histogram."""
    base = df.select(F.array_distinct(F.col(col)).alias("_l")).filter(F.col("_l").isNotNull())
    rows = base.agg(F.count(F.lit(1))).scalar()
    shares = (base.select(F.explode("_l").alias("label")).groupBy("label")
              .agg(F.count(F.lit(1)).alias("rows")).withColumn("share", F.col("rows") / rows))
    lengths = (base.groupBy(F.size("_l").alias("labels")).agg(F.count(F.lit(1)).alias("rows"))
               .withColumn("share", F.col("rows") / rows))
    return shares, lengths


def label_pairs(df: DataFrame, col: str, vocabulary: list[str]) -> DataFrame:
    """Co-occurrence counts of label pairs a < b over rows of a multi-label column.

    Computed as ONE aggregate of ``count_if(contains a and contains b)`` per
    vocabulary pair, so no row ever emits its own pairs.  Multi-label
    vocabularies are enum-sized (profiling only calls this for ≤ enum_max labels).
    """
    voc = sorted(set(vocabulary))
    specs = {}
    arr = F.col(col)
    for i, a in enumerate(voc):
        for b in voc[i + 1:]:
            specs[f"{a}\u0001{b}"] = [("rows", F.count_if(F.array_contains(arr, a) & F.array_contains(arr, b)),
                                       "bigint")]
    if not specs:
        return df.sparkSession.createDataFrame([], "a string, b string, rows bigint")
    out = _one_row_unpivot(df, specs)
    parts = F.split(F.col("column"), "\u0001")
    return out.select(parts[0].alias("a"), parts[1].alias("b"), "rows")


def label_vocabulary(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(F.col(col)).alias("label")).filter(F.col("label").isNotNull()).distinct()


def unique_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, n, distinct, is_unique)``; unique = every non-null value occurs once."""
    found = digest_counts(df, cols or df.columns)
    return found.select("column", "n", "distinct", ((F.col("distinct") == F.col("n")) & (F.col("n") > 0)).alias("is_unique"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every column pair a < b → ``(a, b, r)``; rows with a null in a pair are left out of it.

    One scan whatever the number of columns: cross-product matrices by task, merged by column
    (:mod:`synthkit.operators.cross`).  A constant column has no correlation (null).
    """
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    return _coefficients(pair_moments(df, [_as_double(df, c) for c in cols]), cols)


def _coefficients(found: DataFrame, cols: list[str]) -> DataFrame:
    """``(a, b, r)`` for a < b from rows of a matrix: products, and squares of both sides."""
    each = F.posexplode(F.arrays_zip("prod", "dev", "dev_t")).alias("j", "e")
    names = F.array(*[F.lit(c) for c in cols])
    spread = F.sqrt(F.col("e.dev")) * F.sqrt(F.col("e.dev_t"))
    return found.select("i", each).where("j > i").select(
        F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), F.when(spread > 0, F.col("e.prod") / spread).alias("r"))


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """``(x, rank)``: 1-based average rank of each distinct value (ties share the mean rank)."""
    vc = (df.select(_as_double(df, col).alias("x")).filter(F.col("x").isNotNull())
          .groupBy("x").agg(F.count(F.lit(1)).alias("cnt")))
    cum = with_running_sums(vc, "x", {"cum": F.col("cnt")})
    return cum.select("x", (F.col("cum") - (F.col("cnt") - 1) / 2.0).alias("rank"))


def rank_correlations(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    """Spearman rho for every pair: Pearson of average ranks over the rows that have both columns of the pair.

    Each column is ranked once for each null pattern among its partners (:mod:`synthkit.operators.ranks`), so
    columns without nulls are ranked once.  A pair with a constant column or without complete rows has no
    correlation (null).  ``key`` is not needed any more.
    """
    names = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    pairs = df.sparkSession.createDataFrame(names, "a string, b string")
    if not names:
        return pairs.withColumn("r", F.lit(None).cast("double"))
    found = rank_products(df, [_as_double(df, c) for c in cols])
    return pairs.join(_coefficients(found, cols), ["a", "b"], "left")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramér's V from the observed contingency cells: chi2 = n(Σ O²/(r_a c_b) − 1)."""
    cells = (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(a, b).agg(F.count(F.lit(1)).alias("o")))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    j = cells.join(ra, a).join(cb, b)
    s = j.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("q"),
              F.sum("o").alias("n"), F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c"))
    chi2 = F.col("n") * (F.col("q") - 1)
    k = F.least(F.col("r"), F.col("c")) - 1
    return s.select(F.lit(a).alias("a"), F.lit(b).alias("b"), chi2.alias("chi2"),
                    F.when(k > 0, F.sqrt(chi2 / (F.col("n") * k))).alias("cramers_v"))


def corr_ratio(df: DataFrame, cat: str, num: str) -> DataFrame:
    """Correlation ratio eta of a number on a category: sqrt(between SS / total SS)."""
    x = F.col(num).cast("double")
    base = df.filter(F.col(cat).isNotNull() & x.isNotNull()).select(F.col(cat).alias("c"), x.alias("x"))
    g = base.groupBy("c").agg(F.count(F.lit(1)).alias("nc"), F.avg("x").alias("mc"))
    m = base.agg(F.avg("x")).scalar()
    s = g.agg(F.sum(F.col("nc") * (F.col("mc") - m) ** 2).alias("between"),
              F.sum("nc").alias("n")).withColumn("v", base.agg(F.var_pop("x")).scalar())
    return s.select(F.lit(cat).alias("cat"), F.lit(num).alias("num"),
                    F.when(F.col("v") > 0, F.sqrt(F.col("between") / (F.col("v") * F.col("n"))))
                    .alias("eta"))
