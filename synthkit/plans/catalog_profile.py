"""Registered queries: schema inference and distribution fitting (F1-F21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthkit.operators import profile, schema
from synthkit.plans.registry import num_text_sql, register, rounded, table, u_sql

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL = [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
          ("l_quantity", "num"), ("l_extendedprice", "num"), ("l_discount", "num"), ("l_tax", "num"),
          ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "time")]
ORDERS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"), ("o_totalprice", "num"),
          ("o_orderdate", "time"), ("o_orderpriority", "str")]
EVENTS = [("event_id", "int"), ("ts", "time"), ("user_id", "int"), ("event_type", "str"),
          ("value", "num"), ("props", "str")]


def _stats_sql(tbl: str, cols) -> str:
    parts = []
    for c, kind in cols:
        num = kind in ("int", "num")
        x = f"CAST({c} AS DOUBLE)"
        if num:
            moments = (f"round(min({x}), 6) AS min, round(max({x}), 6) AS max, round(CAST(sum(CAST({c} AS DECIMAL(28, 10))) AS DOUBLE) / count({c}), 6) AS mean, "
                       f"round(stddev_samp({x}), 6) AS stddev, "
                       f"round(avg(power({x} - mu, 3)) / power(avg(power({x} - mu, 2)), 1.5), 6) AS skewness, "
                       f"round(avg(power({x} - mu, 4)) / power(avg(power({x} - mu, 2)), 2) - 3, 6) AS kurtosis")
            src = f"{tbl}, (SELECT avg({x}) AS mu FROM {tbl}) m"
        else:
            moments = ", ".join(f"CAST(NULL AS DOUBLE) AS {s}" for s in
                                ("min", "max", "mean", "stddev", "skewness", "kurtosis"))
            src = tbl
        parts.append(f"SELECT '{c}' AS column, count({c}) AS n, count(*) - count({c}) AS nulls, "
                     f"count(DISTINCT {c}) AS distinct, {moments} FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _type_sql(tbl: str, c: str, kind: str, enum_max: int = 50, rate: float = 0.99) -> str:
    """DuckDB text of the type rules of :func:`profile.infer_types` for one column."""
    small = f"count(DISTINCT {c}) <= {enum_max}"
    if kind == "int":
        return f"CASE WHEN {small} THEN 'enum' ELSE 'int' END"
    if kind == "num":
        return "CASE WHEN count(*) >= 0 THEN 'float' END"
    if kind == "time":
        return "CASE WHEN count(*) >= 0 THEN 'date' END"
    n = f"greatest(count({c}), 1)"
    r = lambda cond: f"(count(*) FILTER (WHERE {cond}) / {n})"
    uuid = r(f"regexp_full_match({c}, '{profile.UUID_PATTERN}')")
    unique = f"(count(DISTINCT {c}) = count({c}) AND count({c}) > {enum_max})"
    return (f"CASE WHEN {uuid} >= {rate} THEN 'uuid' "
            f"WHEN {r(f'TRY_CAST({c} AS BIGINT) IS NOT NULL')} >= {rate} THEN CASE WHEN {small} THEN 'enum' ELSE 'int' END "
            f"WHEN {r(f'TRY_CAST({c} AS DOUBLE) IS NOT NULL')} >= {rate} THEN 'float' "
            f"WHEN {r(f'TRY_CAST({c} AS DATE) IS NOT NULL')} >= {rate} THEN 'date' "
            f"WHEN {small} THEN 'enum' "
            f"WHEN {unique} AND count(*) FILTER (WHERE regexp_matches({c}, '\\s')) = 0 "
            f"AND max(length({c})) <= 64 THEN 'uuid' ELSE 'text' END")


def _x_sql(c: str, kind: str) -> str:
    return f"epoch({c})" if kind == "time" else f"CAST({c} AS DOUBLE)"


def _fit_sql(tbl: str, c: str, kind: str) -> str:
    """One row of :func:`profile.fit_best` (AIC of the four families) for one column."""
    x = _x_sql(c, kind)
    return f"""SELECT '{c}' AS column, n, mu, sigma, rate, lo, hi, mu_log, sigma_log,
  4.0 + n * (ln(2 * pi() * var_pop) + 1) AS aic_gaussian,
  CASE WHEN n_pos = n THEN 4.0 + 2 * sl + n * (ln(2 * pi() * vl_pop) + 1) END AS aic_lognormal,
  CASE WHEN hi > lo THEN 4.0 + 2 * n * ln(hi - lo) END AS aic_uniform,
  CASE WHEN n_neg = 0 AND mu > 0 THEN 2.0 - 2 * n * ln(1.0 / mu) + 2 * n END AS aic_exponential
FROM (SELECT count({x}) AS n, avg({x}) AS mu, stddev_samp({x}) AS sigma, 1.0 / avg({x}) AS rate,
             min({x}) AS lo, max({x}) AS hi, var_pop({x}) AS var_pop,
             count(*) FILTER (WHERE {x} > 0) AS n_pos, count(*) FILTER (WHERE {x} < 0) AS n_neg,
             sum(CASE WHEN {x} > 0 THEN ln({x}) END) AS sl,
             avg(CASE WHEN {x} > 0 THEN ln({x}) END) AS mu_log,
             stddev_samp(CASE WHEN {x} > 0 THEN ln({x}) END) AS sigma_log,
             var_pop(CASE WHEN {x} > 0 THEN ln({x}) END) AS vl_pop FROM {tbl})"""


_FAMILY_SQL = """CASE
  WHEN least(coalesce(aic_gaussian, 'Infinity'), coalesce(aic_lognormal, 'Infinity'),
             coalesce(aic_uniform, 'Infinity'), coalesce(aic_exponential, 'Infinity')) = aic_gaussian THEN 'gaussian'
  WHEN least(coalesce(aic_lognormal, 'Infinity'), coalesce(aic_uniform, 'Infinity'),
             coalesce(aic_exponential, 'Infinity')) = aic_lognormal THEN 'lognormal'
  WHEN least(coalesce(aic_uniform, 'Infinity'), coalesce(aic_exponential, 'Infinity')) = aic_uniform THEN 'uniform'
  ELSE 'exponential' END"""


def _fit_best_sql(tbl, cols) -> str:
    body = "\nUNION ALL\n".join(_fit_sql(tbl, c, k) for c, k in cols)
    r = lambda e: f"round({e}, 6)"
    return f"""WITH f AS ({body}), g AS (SELECT *, {_FAMILY_SQL} AS family FROM f)
SELECT "column", family,
  {r("CASE family WHEN 'gaussian' THEN aic_gaussian WHEN 'lognormal' THEN aic_lognormal "
     "WHEN 'uniform' THEN aic_uniform ELSE aic_exponential END")} AS aic,
  {r('mu')} AS mu, {r('sigma')} AS sigma, {r('rate')} AS rate, {r('lo')} AS lo, {r('hi')} AS hi,
  {r('mu_log')} AS mu_log, {r('sigma_log')} AS sigma_log, CAST(n AS BIGINT) AS n,
  {r('aic_gaussian')} AS aic_gaussian, {r('aic_lognormal')} AS aic_lognormal,
  {r('aic_uniform')} AS aic_uniform, {r('aic_exponential')} AS aic_exponential
FROM g"""


@register("column_stats", _stats_sql("lineitem", LI_ALL))
def q_column_stats(spark, sf):
    return rounded(profile.column_stats(table(spark, sf, "lineitem")))


def _types_sql(tbl, cols):
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS column, {_type_sql(tbl, c, k)} AS type FROM {tbl}"
                                for c, k in cols)


@register("infer_types", _types_sql("events", EVENTS) + "\nUNION ALL\n" + _types_sql("orders", ORDERS))
def q_infer_types(spark, sf):
    a = profile.infer_types(table(spark, sf, "events")).select("column", "type")
    b = profile.infer_types(table(spark, sf, "orders")).select("column", "type")
    return a.unionByName(b)


_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@register("quantiles", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount"] for p in _PROBS))
def q_quantiles(spark, sf):
    return rounded(profile.quantiles(table(spark, sf, "lineitem"),
                                     ["l_quantity", "l_extendedprice", "l_discount"], _PROBS))


@register("histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT CAST(least(greatest(floor((l_extendedprice - lo) / ((hi - lo) / 20)) + 1, 1), 20) AS INTEGER) AS bin,
             lo, hi FROM lineitem, b WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 20), 6) AS lo, round(lo + bin * ((hi - lo) / 20), 6) AS hi,
       count(*) AS count
FROM h GROUP BY bin, lo, hi""")
def q_histogram(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20))


@register("category_shares", """
SELECT c_mktsegment AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""")
def q_category_shares(spark, sf):
    return rounded(profile.category_shares(table(spark, sf, "customer"), "c_mktsegment"))


@register("entropy", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS categories FROM (
  SELECT count(*) / sum(count(*)) OVER () AS p FROM orders WHERE {c} IS NOT NULL GROUP BY CAST({c} AS VARCHAR))"""
                                          for c in ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def q_entropy(spark, sf):
    return rounded(profile.entropy(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]))


@register("fit_best", "SELECT * FROM (" + _fit_best_sql("events", [("value", "num"), ("user_id", "int"),
                                                                   ("event_id", "int")])
          + ")\nUNION ALL\nSELECT * FROM (" + _fit_best_sql("orders", [("o_totalprice", "num"),
                                                                      ("o_orderdate", "time")]) + ")")
def q_fit_best(spark, sf):
    a = profile.fit_best(table(spark, sf, "events"), ["value", "user_id", "event_id"])
    b = profile.fit_best(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate"])
    return rounded(a.unionByName(b))


@register("fit_gaussian", """
SELECT round(avg(l_quantity), 6) AS mu, round(stddev_samp(l_quantity), 6) AS sigma, count(l_quantity) AS n
FROM lineitem""")
def q_fit_gaussian(spark, sf):
    return rounded(profile.fit_gaussian(table(spark, sf, "lineitem"), "l_quantity"))


@register("fit_lognormal", """
SELECT round(avg(CASE WHEN value > 0 THEN ln(value) END), 6) AS mu_log,
       round(stddev_samp(CASE WHEN value > 0 THEN ln(value) END), 6) AS sigma_log,
       count(CASE WHEN value > 0 THEN value END) AS n,
       round(count(*) FILTER (WHERE value <= 0) / count(value), 6) AS share_nonpos
FROM events""")
def q_fit_lognormal(spark, sf):
    return rounded(profile.fit_lognormal(table(spark, sf, "events"), "value"))


@register("fit_uniform", """
SELECT round(epoch(min(o_orderdate)), 6) AS lo, round(epoch(max(o_orderdate)), 6) AS hi,
       year(min(o_orderdate)) AS year_lo, year(max(o_orderdate)) AS year_hi FROM orders""")
def q_fit_uniform(spark, sf):
    return rounded(profile.fit_uniform(table(spark, sf, "orders"), "o_orderdate"))


@register("fit_exponential", "SELECT round(1.0 / avg(value), 6) AS rate, count(value) AS n FROM events")
def q_fit_exponential(spark, sf):
    return rounded(profile.fit_exponential(table(spark, sf, "events"), "value"))


def _priority_labels(spark, sf):
    """Order priorities of each customer as a multi-label column (set size ≤ distinct priorities)."""
    return (table(spark, sf, "orders").groupBy("o_custkey")
            .agg(F.collect_set("o_orderpriority").alias("priorities")))


_LABELS_SQL = "(SELECT o_custkey, list(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey)"


@register("fit_multilabel_shares", f"""
SELECT label, count(*) AS rows, round(count(*) / (SELECT count(*) FROM {_LABELS_SQL}), 6) AS share
FROM (SELECT unnest(priorities) AS label FROM {_LABELS_SQL}) GROUP BY label""")
def q_fit_multilabel_shares(spark, sf):
    return rounded(profile.fit_multilabel(_priority_labels(spark, sf), "priorities")[0])


@register("fit_multilabel_lengths", f"""
SELECT CAST(len(priorities) AS INTEGER) AS labels, count(*) AS rows,
       round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM {_LABELS_SQL} GROUP BY len(priorities)""")
def q_fit_multilabel_lengths(spark, sf):
    return rounded(profile.fit_multilabel(_priority_labels(spark, sf), "priorities")[1])


@register("label_pairs", f"""
SELECT a.l AS a, b.l AS b, count(*) AS rows
FROM (SELECT o_custkey, unnest(priorities) AS l FROM {_LABELS_SQL}) a
JOIN (SELECT o_custkey, unnest(priorities) AS l FROM {_LABELS_SQL}) b ON a.o_custkey = b.o_custkey AND a.l < b.l
GROUP BY a.l, b.l""")
def q_label_pairs(spark, sf):
    labels = _priority_labels(spark, sf)
    voc = [r[0] for r in profile.label_vocabulary(labels, "priorities").collect()]
    if len(voc) > 50:
        raise ValueError("label vocabulary larger than enum_max; not a multi-label column")
    return profile.label_pairs(labels, "priorities", voc).filter(F.col("rows") > 0)


@register("unique_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count({c}) AS n, count(DISTINCT {c}) AS distinct, "
    f"count(DISTINCT {c}) = count({c}) AND count({c}) > 0 AS is_unique FROM orders" for c, _ in ORDERS))
def q_unique_columns(spark, sf):
    return profile.unique_columns(table(spark, sf, "orders"))


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("correlations", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _pairs(LI_NUM)))
def q_correlations(spark, sf):
    return rounded(profile.correlations(table(spark, sf, "lineitem"), LI_NUM))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                   for c in LI_NUM)


@register("rank_correlations", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM (SELECT {_RANKS} FROM lineitem)"
    for a, b in _pairs(LI_NUM)))
def q_rank_correlations(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rounded(profile.rank_correlations(li, LI_NUM, "row_key"))


@register("cramers_v", """
WITH cells AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders
               WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
j AS (SELECT o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, a, b FROM cells),
s AS (SELECT sum(o * o / (ra * cb)) AS q, sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM j)
SELECT 'o_orderstatus' AS a, 'o_orderpriority' AS b, round(n * (q - 1), 6) AS chi2,
       round(CASE WHEN least(r, c) - 1 > 0 THEN sqrt(n * (q - 1) / (n * (least(r, c) - 1))) END, 6) AS cramers_v
FROM s""")
def q_cramers_v(spark, sf):
    return rounded(profile.cramers_v(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


@register("corr_ratio", """
WITH base AS (SELECT l_returnflag AS c, l_extendedprice AS x FROM lineitem
              WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL),
g AS (SELECT count(*) AS nc, avg(x) AS mc FROM base GROUP BY c),
t AS (SELECT avg(x) AS m, var_pop(x) AS v, count(*) AS n FROM base)
SELECT 'l_returnflag' AS cat, 'l_extendedprice' AS num,
       round(CASE WHEN v > 0 THEN sqrt(sum(nc * (mc - m) * (mc - m)) / (v * n)) END, 6) AS eta
FROM g, t GROUP BY v, n""")
def q_corr_ratio(spark, sf):
    return rounded(profile.corr_ratio(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


def _schema_sql(tbl: str, cols, seed: int = 0, enum_max: int = 50) -> str:
    """DuckDB text of :func:`schema.infer_schema` for a table with known column kinds."""
    rows = []
    for c, k in cols:
        v = f"CAST({c} AS VARCHAR)"
        typ = _type_sql(tbl, c, k, enum_max)
        sample_v = f"(SELECT arg_min(v, {u_sql(seed, 'sample_value', 'v')}) FROM (SELECT DISTINCT {v} AS v FROM {tbl} WHERE {c} IS NOT NULL))"
        shares = (f"(SELECT '{{' || string_agg(v || ':' || {num_text_sql('cnt / n')}, ', ' ORDER BY cnt DESC, v) || '}}' "
                  f"FROM (SELECT {v} AS v, count(*) AS cnt, sum(count(*)) OVER () AS n FROM {tbl} "
                  f"WHERE {c} IS NOT NULL GROUP BY 1))")
        if k in ("int", "num", "time"):
            fit = f"(SELECT {_FAMILY_SQL} FROM ({_fit_sql(tbl, c, k)}))"
            par = f"(SELECT {{}} FROM ({_fit_sql(tbl, c, k)}))"
            num = (f"CASE {fit} WHEN 'gaussian' THEN printf('Gaussian (μ=%s, σ=%s)', {par.format(num_text_sql('mu'))}, {par.format(num_text_sql('sigma'))}) "
                   f"WHEN 'lognormal' THEN printf('LogNormal (μ=%s, σ=%s)', {par.format(num_text_sql('mu_log'))}, {par.format(num_text_sql('sigma_log'))}) "
                   f"WHEN 'uniform' THEN printf('Uniform (%s, %s)', {par.format(num_text_sql('lo'))}, {par.format(num_text_sql('hi'))}) "
                   f"ELSE printf('Exponential (λ=%s)', {par.format(num_text_sql('rate', 4))}) END")
            date = "NULL"
        else:
            num = date = "NULL"
        if k == "time":
            date = (f"CASE {fit} WHEN 'uniform' THEN 'Uniform ' || CAST(year(min({c})) AS VARCHAR) || '-' "
                    f"|| CAST(year(max({c})) AS VARCHAR) END")
        unique = f"(count(DISTINCT {c}) = count({c}) AND count({c}) > {enum_max})"
        rows.append(f"""SELECT '{c}' AS column, {typ} AS type,
  CASE WHEN {unique} AND ({typ}) IN ('uuid', 'int', 'text') THEN 'unique'
       WHEN ({typ}) = 'enum' THEN {shares}
       WHEN ({typ}) IN ('int', 'float') THEN {num}
       WHEN ({typ}) = 'date' THEN {date}
       WHEN ({typ}) = 'text' THEN 'Text' ELSE 'JSON' END AS distribution,
  CASE WHEN ({typ}) = 'uuid' THEN (CASE WHEN length({sample_v}) > 8 THEN substr({sample_v}, 1, 5) || '…' || right({sample_v}, 2) ELSE {sample_v} END)
       WHEN ({typ}) = 'float' THEN {num_text_sql(f'CAST({sample_v} AS DOUBLE)')}
       WHEN ({typ}) = 'date' THEN substr({sample_v}, 1, 10)
       ELSE {sample_v} END AS sample
FROM {tbl}""")
    return "\nUNION ALL\n".join(rows)


@register("infer_schema", _schema_sql("orders", ORDERS))
def q_infer_schema(spark, sf):
    return schema.infer_schema(table(spark, sf, "orders"))


@register("infer_schema_events", _schema_sql("events", EVENTS))
def q_infer_schema_events(spark, sf):
    return schema.infer_schema(table(spark, sf, "events"))


_STRIP = "^[a-z]{1,2}_"


@register("align_schemas", f"""
WITH t AS ({_types_sql('customer', [('c_custkey', 'int'), ('c_name', 'str'), ('c_nationkey', 'int'),
                                    ('c_acctbal', 'num'), ('c_mktsegment', 'str')])}),
s AS ({_types_sql('supplier', [('s_suppkey', 'int'), ('s_name', 'str'), ('s_nationkey', 'int'),
                                ('s_acctbal', 'num')])}),
sig AS (SELECT regexp_replace("column", '{_STRIP}', '') AS "column", 'customer' AS source, type FROM t
        UNION ALL SELECT regexp_replace("column", '{_STRIP}', '') AS "column", 'supplier' AS source, type FROM s)
SELECT "column", array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
       array_to_string(list_sort(list(DISTINCT type)), ',') AS types,
       count(DISTINCT source) AS n_sources, count(DISTINCT type) > 1 AS conflict
FROM sig GROUP BY 1""")
def q_align_schemas(spark, sf):
    out = schema.align_schemas({"customer": table(spark, sf, "customer"),
                                "supplier": table(spark, sf, "supplier")}, strip=_STRIP)
    return out.select("column", F.array_join("sources", ",").alias("sources"),
                      F.array_join("types", ",").alias("types"), F.col("n_sources").cast("bigint").alias("n_sources"),
                      "conflict")


@register("merge_sources", """
SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS INTEGER) AS nationkey,
       round(c_acctbal, 6) AS acctbal, c_mktsegment AS segment, 'customer' AS source FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 6), NULL, 'supplier' FROM supplier""")
def q_merge_sources(spark, sf):
    ren = {"customer": {"c_custkey": "key", "c_name": "name", "c_nationkey": "nationkey", "c_acctbal": "acctbal",
                        "c_mktsegment": "segment"},
           "supplier": {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nationkey", "s_acctbal": "acctbal"}}
    out = schema.merge_sources({"customer": table(spark, sf, "customer"),
                                "supplier": table(spark, sf, "supplier")}, rename=ren)
    return rounded(out)
