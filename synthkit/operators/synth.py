"""Synthesis: every generator is a Column expression over ``spark.range(n)``.

No generator shuffles, and each row depends only on (seed, column, row id),
so the output is identical for any partitioning and any retry.  Parameters
come from a spec (see :mod:`synthkit.plans.spec`); they are literals, never
data.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthkit.functions.random import normal, normal_cdf, uniform, uuid_text
from synthkit.operators.conditions import truncated_normal
from synthkit.operators.labels import gen_label_sets
from synthkit.operators.ordering import with_position, with_running_sums

ID = "id"
CASE_CHAIN_MAX = 64  # above this many categories a when-chain gives way to a binary search


def _lit(x) -> Column:
    return F.lit(float(x))


def gen_unique(seed: int, name: str, prefix: str = "", key: Column | None = None) -> Column:
    return uuid_text(seed, name, key if key is not None else F.col(ID), prefix)


def gen_gaussian(z: Column, mu: float, sigma: float, as_int: bool = False) -> Column:
    x = _lit(mu) + _lit(sigma) * z
    return F.round(x).cast("bigint") if as_int else x


def gen_lognormal(z: Column, mu_log: float, sigma_log: float) -> Column:
    return F.exp(_lit(mu_log) + _lit(sigma_log) * z)


def gen_uniform(u: Column, lo: float, hi: float, as_int: bool = False) -> Column:
    if as_int:  # every integer in [lo, hi] equally likely
        return (_lit(lo) + F.floor(u * (_lit(hi) - _lit(lo) + 1))).cast("bigint")
    return _lit(lo) + u * (_lit(hi) - _lit(lo))


def gen_uniform_date(u: Column, lo: str, hi: str) -> Column:
    """Uniform calendar date in [lo, hi] (ISO strings)."""
    days = F.datediff(F.lit(hi).cast("date"), F.lit(lo).cast("date")) + 1
    return F.date_add(F.lit(lo).cast("date"), F.floor(u * days).cast("int"))


def gen_uniform_timestamp(u: Column, lo_epoch: float, hi_epoch: float, ntz: bool = True) -> Column:
    """Uniform instant in [lo, hi] (epoch seconds), microsecond precision, time-zone free."""
    secs = F.floor((_lit(lo_epoch) + u * (_lit(hi_epoch) - _lit(lo_epoch))) * 1e6) / F.lit(1e6)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ts = epoch + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))
    return ts if ntz else ts.cast("timestamp")


def gen_exponential(u: Column, rate: float) -> Column:
    return -F.log(F.lit(1.0) - u) / _lit(rate)


def _cum_bounds(shares: list[tuple[str, float]]) -> list[tuple[str, float, float]]:
    """[(value, lo, hi)] with hi of the last = 1.  Shares are normalised by their sum."""
    total = sum(s for _, s in shares)
    out, acc = [], 0.0
    for i, (v, s) in enumerate(shares):
        lo = acc
        acc = acc + s
        out.append((v, lo / total, 1.0 if i == len(shares) - 1 else acc / total))
    return out


def gen_category(u: Column, shares: list[tuple[str, float]]) -> Column:
    """Category with probability ``share``; ``shares`` in a fixed order (e.g. by count desc).

    A ``when`` chain for few categories; for more, a binary search in the
    sorted upper bounds (an array literal: the spec holds the categories).
    Categories that are data rather than parameters go through
    :func:`category_intervals` + :func:`join_categories`.
    """
    bounds = _cum_bounds(shares)
    if len(shares) > CASE_CHAIN_MAX:
        uppers, values = F.array(*[_lit(hi) for _, _, hi in bounds[:-1]]), F.array(*[F.lit(v) for v, _, _ in bounds])
        state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"))

        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            open_, below = s["lo"] < s["hi"], u < F.get(uppers, mid)
            return F.struct(F.when(open_ & ~below, mid + 1).otherwise(s["lo"]).alias("lo"),
                            F.when(open_ & below, mid).otherwise(s["hi"]).alias("hi"))
        steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
        return F.get(values, F.aggregate(steps, state, halve, lambda s: s["lo"]))
    expr = F.lit(bounds[-1][0])
    for v, _lo, hi in reversed(bounds[:-1]):
        expr = F.when(u < _lit(hi), F.lit(v)).otherwise(expr)
    return expr


def category_intervals(counts: DataFrame, value: str, count: str) -> DataFrame:
    """(value, lo, hi) from a count table, largest count first: positions and running sums are distributed."""
    ordered = with_position(counts.select(F.col(value).alias("value"), F.col(count).alias("c")), [F.desc("c"), F.col("value")], "pos")
    cum = with_running_sums(ordered, "pos", {"upto": F.col("c")}, total_prefix="n_")
    last = F.col("upto") == F.col("n_upto")
    return cum.select("value", ((F.col("upto") - F.col("c")) / F.col("n_upto")).alias("lo"),
                      F.when(last, 1.0).otherwise(F.col("upto") / F.col("n_upto")).alias("hi"))


def join_categories(df: DataFrame, u: Column, intervals: DataFrame, out: str, buckets: int) -> DataFrame:
    """Range join u ∈ [lo, hi) as an equi-join on floor(u·B) plus a filter.

    Each interval is listed in every bucket it overlaps (B plus one row per
    category in all).  Draws are spread evenly over the buckets, so no key is hot.
    """
    b = F.lit(buckets)
    listed = intervals.select("value", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * b), F.least(b - 1, F.floor(F.col("hi") * b)))).alias("_sk_b"))
    probe = df.withColumn("_sk_u", u).withColumn("_sk_b", F.floor(F.col("_sk_u") * b))
    j = probe.join(listed, "_sk_b").where((F.col("_sk_u") >= F.col("lo")) & (F.col("_sk_u") < F.col("hi")))
    return j.withColumnRenamed("value", out).drop("_sk_u", "_sk_b", "lo", "hi")


def gen_multilabel(seed: int, name: str, shares: list[tuple[str, float]], mode: str = "md5",
                   key: Column | None = None) -> Column:
    """Each label independently with its share (one Bernoulli uniform per label); with the source's lengths see
    :func:`synthkit.operators.labels.gen_label_sets`."""
    key = key if key is not None else F.col(ID)
    picks = [F.when(uniform(seed, f"{name}:{lab}", key, mode) < _lit(s), F.lit(lab)) for lab, s in shares]
    return F.filter(F.array(*picks), lambda x: x.isNotNull())


def gen_empirical(u: Column, qs: list[float]) -> Column:
    """Inverse ECDF with linear interpolation on an equally spaced quantile grid ``qs``."""
    k = len(qs) - 1
    arr = F.array(*[_lit(q) for q in qs])
    pos = u * F.lit(float(k))
    i = F.least(F.floor(pos), F.lit(k - 1)).cast("int")
    frac = pos - i
    a = F.element_at(arr, i + 1)
    b = F.element_at(arr, i + 2)
    return a + frac * (b - a)


def with_nulls(c: Column, u: Column, rate: float) -> Column:
    return F.when(u >= _lit(rate), c) if rate > 0 else c


def latent_cholesky(names: list[str], corr: list[tuple[str, str, float]], spearman: bool = True) -> np.ndarray:
    """Lower Cholesky factor of the latent normal correlation (Spearman → Pearson: 2 sin(πρ/6)).

    k×k on the driver, k = number of columns; the matrix is nudged to the
    nearest positive definite one when the pairwise estimates disagree.
    """
    k = len(names)
    idx = {n: i for i, n in enumerate(names)}
    m = np.eye(k)
    for a, b, r in corr:
        if a in idx and b in idx and r is not None and not math.isnan(r):
            rr = 2 * math.sin(math.pi * r / 6) if spearman else r
            m[idx[a], idx[b]] = m[idx[b], idx[a]] = rr
    w, v = np.linalg.eigh(m)
    if w.min() <= 1e-9:
        w = np.clip(w, 1e-6, None)
        m = v @ np.diag(w) @ v.T
        d = np.sqrt(np.diag(m))
        m = m / np.outer(d, d)
    return np.linalg.cholesky(m)


def independent_normals(seed: int, names: list[str], mode: str = "md5", key: Column | None = None, first: Column | None = None) -> list[Column]:
    """One hash normal for each name; ``first`` replaces the first one."""
    key = key if key is not None else F.col(ID)
    e = [normal(seed, f"latent:{n}", key, mode) for n in names]
    if first is not None:
        e[0] = first
    return e


def _combined(names: list[str], chol: np.ndarray, e: list[Column]) -> dict[str, Column]:
    """Latent z for each name: z = L·e (pure Column arithmetic)."""
    out = {}
    for i, n in enumerate(names):
        expr = None
        for j in range(i + 1):
            if chol[i, j] != 0.0:
                term = _lit(chol[i, j]) * e[j]
                expr = term if expr is None else expr + term
        out[n] = expr
    return out


def column_expr(col: dict, seed: int, mode: str, z: Column | None = None) -> Column:
    """One spec column → Column over ``id``.  ``z`` (latent normal) ties it to the copula."""
    name, typ = col["name"], col["type"]
    d = col.get("dist", {})
    fam = d.get("family")
    key = F.col(ID)
    if z is None:  # independent column: its own uniform, and a normal for the normal families
        u = uniform(seed, name, key, mode)
        z = normal(seed, name, key, mode)
    else:  # copula column: the latent normal drives every family
        u = normal_cdf(z)
    as_int = col.get("spark_type", "") in ("bigint", "int", "smallint", "tinyint")
    if typ == "uuid":
        expr = gen_unique(seed, name, d.get("prefix", ""))
    elif fam == "sequence":  # unique integers
        expr = (F.col(ID) + F.lit(int(d.get("lo", 0)))).cast("bigint")
    elif typ == "enum":
        expr = gen_category(u, [(s["value"], s["share"]) for s in d["shares"]]) if d["shares"] else F.lit(None).cast("string")
        st = col.get("spark_type", "string")
        if st != "string":
            expr = expr.cast(st)
    elif typ == "array<str>":
        shares = [(s["value"], s["share"]) for s in d["shares"]]
        expr = gen_label_sets(seed, name, shares, [(s["labels"], s["share"]) for s in d["lengths"]], mode) if d.get("lengths") \
            else gen_multilabel(seed, name, shares, mode)
    elif typ == "date":
        if col.get("spark_type") == "date" or d.get("unit") == "day":
            expr = gen_uniform_date(u, d["lo_date"], d["hi_date"])
            if col.get("spark_type") in ("timestamp", "timestamp_ntz"):
                expr = expr.cast(col["spark_type"])
        else:
            expr = gen_uniform_timestamp(u, d["lo"], d["hi"], ntz=col.get("spark_type") == "timestamp_ntz")
    elif fam == "gaussian":
        expr = gen_gaussian(z, d["mu"], d["sigma"], as_int)
    elif fam == "lognormal":
        expr = gen_lognormal(z, d["mu_log"], d["sigma_log"])
    elif fam == "uniform":
        expr = gen_uniform(u, d["lo"], d["hi"], as_int)
    elif fam == "exponential":
        expr = gen_exponential(u, d["rate"])
    elif fam == "empirical":
        expr = gen_empirical(u, d["quantiles"])
    else:
        raise ValueError(f"column {name}: no generator for type {typ!r} family {fam!r}")
    if fam in ("lognormal", "exponential", "empirical") and as_int:
        expr = F.round(expr).cast("bigint")
    rate = float(col.get("null_rate") or 0.0)
    return with_nulls(expr, uniform(seed, f"null:{name}", key, mode), rate).alias(name)


def synthesize(spark: SparkSession, spec: dict, rows: int | None = None, start: int = 0,
               num_partitions: int | None = None, given=None) -> DataFrame:
    """Whole dataset from a spec: one narrow select over ``spark.range``.

    Columns listed in ``spec['corr']`` share a Gaussian copula (Cholesky of
    the latent correlation); the others draw independent normals.  ``given``
    (:class:`synthkit.operators.conditions.Given`) draws bounded columns inside their bounds.
    """
    n = int(rows if rows is not None else spec["rows"])
    seed, mode = int(spec.get("seed", 0)), spec.get("mode", "md5")
    cols = spec["columns"]
    corr = spec.get("corr") or []
    linked = sorted({c for a, b, _ in corr for c in (a, b)} & {c["name"] for c in cols})
    zs = {}
    lead = None
    if linked and given is not None and given.linked:
        name, lo, hi = given.linked
        linked = [name, *(n for n in linked if n != name)]
        lead = truncated_normal(uniform(seed, f"given:{name}", F.col(ID), mode), lo, hi)
    base = spark.range(start, start + n, numPartitions=num_partitions) if num_partitions else \
        spark.range(start, start + n)
    if linked:  # the normals are projected once, then combined: column i does not repeat those before it.  The generator
        # (one row each) keeps filters on the columns from being pushed down with a copy of the normals' expressions.
        chol = latent_cholesky(linked, corr, spearman=spec.get("corr_kind", "spearman") == "spearman")
        e = independent_normals(seed, linked, mode, first=lead)
        base = base.select(ID, *[c.alias(f"_e{i}") for i, c in enumerate(e)])
        mixed = _combined(linked, chol, [F.col(f"_e{i}") for i in range(len(e))])
        base = base.select(ID, F.inline(F.array(F.struct(*[mixed[name].alias(f"_z{i}") for i, name in enumerate(linked)]))))
        zs = {name: F.col(f"_z{i}") for i, name in enumerate(linked)}
    drawn = given.columns if given is not None else {}
    return base.select(F.col("id"), *[drawn[c["name"]] if c["name"] in drawn else column_expr(c, seed, mode, zs.get(c["name"])) for c in cols])


def bootstrap(df: DataFrame, n: int, key: str, seed: int = 0, mode: str = "md5") -> DataFrame:
    """``n`` rows drawn with replacement from ``df`` (grounded synthesis).

    Only the keys (unique) are sorted and numbered (distributed, see
    :func:`with_position`); synthetic row i takes position ``floor(u_i·N)`` and
    then joins the source row of that key.
    """
    src = with_position(df.select(key), [F.col(key)], "_sk_pos", start=0)
    big_n = src.count()
    spark = df.sparkSession
    syn = spark.range(n).select(F.col("id").alias("syn_id"),
                                F.floor(uniform(seed, "bootstrap", F.col("id"), mode) * F.lit(big_n))
                                .cast("bigint").alias("_sk_pos"))
    # sizes are planned from compressed files: numbered keys and source rows are merged, never broadcast
    return syn.join(src.hint("merge"), "_sk_pos").drop("_sk_pos").join(df.hint("merge"), key)


def smooth_bootstrap(df: DataFrame, n: int, key: str, cols: list[str], bandwidth: float = 0.1,
                     seed: int = 0, mode: str = "md5") -> DataFrame:
    """Bootstrap plus Gaussian jitter ``bandwidth·σ`` on numeric ``cols`` so rows are not copies."""
    sig = df.agg(*[F.stddev(c).alias(c) for c in cols]).first()  # one row: k numbers
    out = bootstrap(df, n, key, seed, mode)
    for c in cols:
        s = float(sig[c] or 0.0)
        out = out.withColumn(c, F.col(c) + _lit(bandwidth * s) * normal(seed, f"jitter:{c}", F.col("syn_id"), mode))
    return out
