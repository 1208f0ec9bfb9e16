"""Registered queries: generators (G1-G14).  Parameters are fitted on the driver tables and the
row count follows the table, so the work grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthkit.functions.random import normal, uniform, uuid_text
from synthkit.operators import profile, synth
from synthkit.operators.labels import gen_label_sets
from synthkit.plans.registry import normal_sql, register, rounded, table, u_sql
from synthkit.plans.spec import infer_spec


def _n(df):
    return df.count()


@register("uniform_u", f"SELECT o_orderkey, round({u_sql(42, 'u', 'o_orderkey')}, 6) AS u FROM orders")
def q_uniform_u(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(o.select("o_orderkey", uniform(42, "u", F.col("o_orderkey")).alias("u")))


def _uuid_sql(seed, tag, key, prefix):
    h = f"md5(concat_ws(':', '{seed}', '{tag}', CAST({key} AS VARCHAR)))"
    return (f"'{prefix}' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' "
            f"|| substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


@register("gen_unique", f"SELECT c_custkey, {_uuid_sql(7, 'patient_id', 'c_custkey', 'pt_')} AS patient_id FROM customer")
def q_gen_unique(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", uuid_text(7, "patient_id", F.col("c_custkey"), "pt_").alias("patient_id"))


def _ids(tbl):
    return f"(SELECT range AS id FROM range((SELECT count(*) FROM {tbl})))"


@register("gen_gaussian", f"""
WITH p AS (SELECT avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sigma FROM lineitem)
SELECT id, round(mu + sigma * {normal_sql(5, 'qty', 'id')}, 6) AS value FROM {_ids('lineitem')}, p""")
def q_gen_gaussian(spark, sf):
    li = table(spark, sf, "lineitem")
    p = profile.fit_gaussian(li, "l_quantity").first()
    out = spark.range(p["n"]).select("id", synth.gen_gaussian(normal(5, "qty", F.col("id")), p["mu"], p["sigma"])
                                     .alias("value"))
    return rounded(out)


@register("gen_lognormal", f"""
WITH p AS (SELECT avg(ln(value)) FILTER (WHERE value > 0) AS m, stddev_samp(ln(value)) FILTER (WHERE value > 0) AS s
           FROM events)
SELECT id, round(exp(m + s * {normal_sql(5, 'value', 'id')}), 6) AS value FROM {_ids('events')}, p""")
def q_gen_lognormal(spark, sf):
    ev = table(spark, sf, "events")
    p = profile.fit_lognormal(ev, "value").first()
    out = spark.range(_n(ev)).select("id", synth.gen_lognormal(normal(5, "value", F.col("id")), p["mu_log"],
                                                               p["sigma_log"]).alias("value"))
    return rounded(out)


@register("gen_uniform", f"""
WITH p AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT id, round(lo + {u_sql(5, 'price', 'id')} * (hi - lo), 6) AS value FROM {_ids('orders')}, p""")
def q_gen_uniform(spark, sf):
    o = table(spark, sf, "orders")
    p = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    return rounded(spark.range(p["n"]).select("id", synth.gen_uniform(uniform(5, "price", F.col("id")), p["lo"], p["hi"])
                                              .alias("value")))


@register("gen_uniform_date", f"""
WITH p AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)
SELECT id, CAST(lo + CAST(floor({u_sql(5, 'day', 'id')} * (datediff('day', lo, hi) + 1)) AS INTEGER) AS VARCHAR) AS day
FROM {_ids('orders')}, p""")
def q_gen_uniform_date(spark, sf):
    o = table(spark, sf, "orders")
    p = o.agg(F.min(F.to_date("o_orderdate")).cast("string").alias("lo"),
              F.max(F.to_date("o_orderdate")).cast("string").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    d = synth.gen_uniform_date(uniform(5, "day", F.col("id")), p["lo"], p["hi"])
    return spark.range(p["n"]).select("id", d.cast("string").alias("day"))


@register("gen_exponential", f"""
WITH p AS (SELECT 1.0 / avg(value) AS rate FROM events)
SELECT id, round(-ln(1.0 - {u_sql(5, 'wait', 'id')}) / rate, 6) AS value FROM {_ids('events')}, p""")
def q_gen_exponential(spark, sf):
    ev = table(spark, sf, "events")
    p = profile.fit_exponential(ev, "value").first()
    return rounded(spark.range(p["n"]).select("id", synth.gen_exponential(uniform(5, "wait", F.col("id")), p["rate"])
                                              .alias("value")))


def _shares(df, col):
    """Category shares ordered by count desc, value asc (the spec order)."""
    rows = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("c"))
            .orderBy(F.desc("c"), col).collect())  # the spec's shares: one row per category of an enum
    total = sum(r["c"] for r in rows)
    return [(str(r[col]), r["c"] / total) for r in rows]


_CAT_SQL = """
WITH s AS (SELECT {col} AS v, count(*) AS c FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 1),
b AS (SELECT v, (sum(c) OVER w - c) / sum(c) OVER () AS lo,
             CASE WHEN row_number() OVER w = count(*) OVER () THEN 1.0 ELSE sum(c) OVER w / sum(c) OVER () END AS hi
      FROM s WINDOW w AS (ORDER BY c DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT id, {u} AS u FROM {ids})
SELECT id, v AS {out} FROM g JOIN b ON g.u >= b.lo AND g.u < b.hi"""


@register("gen_category", _CAT_SQL.format(col="o_orderpriority", tbl="orders", u=u_sql(5, "priority", "id"),
                                          ids=_ids("orders"), out="priority"))
def q_gen_category(spark, sf):
    o = table(spark, sf, "orders")
    shares = _shares(o, "o_orderpriority")
    return spark.range(_n(o)).select("id", synth.gen_category(uniform(5, "priority", F.col("id")), shares)
                                     .alias("priority"))


@register("gen_category_join", _CAT_SQL.format(col="o_custkey", tbl="orders", u=u_sql(5, "customer", "id"),
                                               ids=_ids("orders"), out="customer").replace(
    "WITH s AS (SELECT o_custkey AS v", "WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS v"))
def q_gen_category_join(spark, sf):
    """Many categories (every customer): intervals stay a table, joined by bucket; nothing is collected."""
    o = table(spark, sf, "orders")
    counts = o.groupBy(F.col("o_custkey").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    intervals = synth.category_intervals(counts, "v", "c")
    n = _n(o)
    return synth.join_categories(spark.range(n), uniform(5, "customer", F.col("id")), intervals, "customer", max(16, n // 8))


_LABELS_SQL = "(SELECT o_custkey, list(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_custkey)"


@register("gen_multilabel", f"""
WITH l AS (SELECT label, count(*) AS r FROM (SELECT unnest(priorities) AS label FROM {_LABELS_SQL}) GROUP BY label),
s AS (SELECT label, r, r / (SELECT count(*) FROM {_LABELS_SQL}) AS share FROM l),
g AS (SELECT id FROM range((SELECT count(*) FROM {_LABELS_SQL})) t(id))
SELECT id, coalesce(string_agg(label, ',' ORDER BY r DESC, label)
                    FILTER (WHERE {u_sql(5, "prio:' || label || '", 'id')} < share), '') AS labels
FROM g, s GROUP BY id""")
def q_gen_multilabel(spark, sf):
    labels = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    shares, _ = profile.fit_multilabel(labels, "p")
    sh = [(r["label"], r["share"]) for r in shares.orderBy(F.desc("rows"), "label").collect()]
    out = spark.range(_n(labels)).select("id", F.array_join(synth.gen_multilabel(5, "prio", sh), ",").alias("labels"))
    return out


@register("gen_label_sets", f"""
WITH h AS (SELECT len(priorities) AS k, count(*) / sum(count(*)) OVER () AS share FROM {_LABELS_SQL} GROUP BY k),
c AS (SELECT k, sum(share) OVER (ORDER BY k) AS hi, sum(share) OVER (ORDER BY k) - share AS lo, max(k) OVER () AS most FROM h),
g AS (SELECT id, {u_sql(5, 'sets:#', 'id')} AS u FROM range((SELECT count(*) FROM {_LABELS_SQL})) t(id))
SELECT id, k AS labels, k AS distinct_labels, 0 AS unknown FROM g JOIN c ON u >= lo AND (u < hi OR k = most)""")
def q_gen_label_sets(spark, sf):
    """Priorities of as many customers as have orders; the SQL gives each row's length (the weights are fitted by rounds)."""
    labels = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    shares, lengths = profile.fit_multilabel(labels, "p")
    sh = [(r["label"], r["share"]) for r in shares.orderBy(F.desc("rows"), "label").collect()]
    sets = gen_label_sets(5, "sets", sh, [(r["labels"], r["share"]) for r in lengths.collect()])
    known = F.array(*[F.lit(lab) for lab, _ in sh])
    return spark.range(_n(labels)).select("id", sets.alias("p")).select(
        "id", F.size("p").cast("bigint").alias("labels"), F.size(F.array_distinct("p")).cast("bigint").alias("distinct_labels"),
        F.size(F.array_except("p", known)).alias("unknown"))


_GRID = [k / 100 for k in range(101)]


@register("gen_empirical", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, [{', '.join(repr(p) for p in _GRID)}]) AS qs FROM lineitem),
g AS (SELECT id, {u_sql(5, 'price', 'id')} * 100.0 AS pos FROM {_ids('lineitem')}),
h AS (SELECT id, pos, CAST(least(floor(pos), 99) AS INTEGER) AS i FROM g)
SELECT id, round(qs[i + 1] + (pos - i) * (qs[i + 2] - qs[i + 1]), 6) AS value FROM h, q""")
def q_gen_empirical(spark, sf):
    li = table(spark, sf, "lineitem")
    qs = {r["prob"]: r["value"] for r in profile.quantiles(li, ["l_extendedprice"], _GRID).collect()}
    grid = [qs[p] for p in _GRID]
    return rounded(spark.range(_n(li)).select("id", synth.gen_empirical(uniform(5, "price", F.col("id")), grid)
                                              .alias("value")))


@register("with_nulls", f"""
SELECT c_custkey, CASE WHEN {u_sql(5, 'null:c_acctbal', 'c_custkey')} >= 0.1 THEN round(c_acctbal, 6) END AS c_acctbal
FROM customer""")
def q_with_nulls(spark, sf):
    c = table(spark, sf, "customer")
    return rounded(c.select("c_custkey", synth.with_nulls(F.col("c_acctbal"),
                                                          uniform(5, "null:c_acctbal", F.col("c_custkey")), 0.1)
                            .alias("c_acctbal")))


_RANK2 = ("rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0")


@register("gen_correlated", f"""
WITH rk AS (SELECT {_RANK2.format(c='l_quantity')} AS a, {_RANK2.format(c='l_extendedprice')} AS b FROM lineitem),
p AS (SELECT 2 * sin(pi() * corr(a, b) / 6) AS r FROM rk),
m AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2,
             stddev_samp(l_extendedprice) AS s2 FROM lineitem),
e AS (SELECT id, {normal_sql(9, 'latent:l_extendedprice', 'id')} AS e1, {normal_sql(9, 'latent:l_quantity', 'id')} AS e2
      FROM {_ids('lineitem')})
SELECT id, round(m2 + s2 * e1, 6) AS l_extendedprice,
       round(m1 + s1 * (r * e1 + sqrt(1 - r * r) * e2), 6) AS l_quantity
FROM e, p, m""")
def q_gen_correlated(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rho = profile.rank_correlations(li, ["l_quantity", "l_extendedprice"], "row_key").first()["r"]
    st = li.agg(F.avg("l_quantity").alias("m1"), F.stddev("l_quantity").alias("s1"),
                F.avg("l_extendedprice").alias("m2"), F.stddev("l_extendedprice").alias("s2"),
                F.count(F.lit(1)).alias("n")).first()
    spec = {"rows": st["n"], "seed": 9, "corr": [["l_quantity", "l_extendedprice", rho]], "columns": [
        {"name": "l_extendedprice", "type": "float", "spark_type": "double",
         "dist": {"family": "gaussian", "mu": st["m2"], "sigma": st["s2"]}},
        {"name": "l_quantity", "type": "float", "spark_type": "double",
         "dist": {"family": "gaussian", "mu": st["m1"], "sigma": st["s1"]}}]}
    return rounded(synth.synthesize(spark, spec))


@register("bootstrap", f"""
WITH src AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders),
syn AS (SELECT id AS syn_id, CAST(floor({u_sql(3, 'bootstrap', 'id')} * (SELECT count(*) FROM orders)) AS BIGINT) AS pos
        FROM {_ids('orders')})
SELECT syn_id, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM syn JOIN src USING (pos)""")
def q_bootstrap(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(synth.bootstrap(o, _n(o), "o_orderkey", seed=3))


@register("smooth_bootstrap", f"""
WITH src AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders),
syn AS (SELECT id AS syn_id, CAST(floor({u_sql(3, 'bootstrap', 'id')} * (SELECT count(*) FROM orders)) AS BIGINT) AS pos
        FROM {_ids('orders')}),
s AS (SELECT stddev_samp(o_totalprice) AS sd FROM orders)
SELECT syn_id, o_orderkey, round(o_totalprice + 0.1 * sd * {normal_sql(3, 'jitter:o_totalprice', 'syn_id')}, 6)
       AS o_totalprice
FROM syn JOIN src USING (pos), s""")
def q_smooth_bootstrap(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(synth.smooth_bootstrap(o, _n(o), "o_orderkey", ["o_totalprice"], 0.1, seed=3))
