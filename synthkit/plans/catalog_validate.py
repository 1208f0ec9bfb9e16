"""Registered queries: constraints (C1-C6) and validation (V1-V27).

Source/synthetic pairs come from whole driver tables: lineitem against a
shifted copy of all its rows, events ``value`` against ``0.8·value`` (tail
compression), events against events without one event type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from synthkit.operators import report, rules, validate
from synthkit.operators.synth import synthesize, with_nulls
from synthkit.functions.random import uniform
from synthkit.plans.registry import normal_sql, register, rounded, table, u_sql
from synthkit.plans.spec import infer_spec, refine

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _ar(spark, sf):
    li = table(spark, sf, "lineitem")
    syn = (li.withColumn("l_extendedprice", F.col("l_extendedprice") * 0.875)
           .withColumn("l_quantity", F.greatest(F.col("l_quantity"), F.lit(4.0)))
           .withColumn("l_discount", F.least(F.col("l_discount"), F.lit(0.07)))
           .withColumn("l_tax", F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_tax")))
           .withColumn("l_linestatus", F.when(F.col("l_linenumber") == 2, "O").otherwise(F.col("l_linestatus"))))
    return li, syn


def _ev(spark, sf):
    ev = table(spark, sf, "events")
    return ev, ev.withColumn("value", F.col("value") * 0.8)


A = "lineitem"
R = """(SELECT * REPLACE (l_extendedprice * 0.875 AS l_extendedprice, greatest(l_quantity, 4.0::DOUBLE) AS l_quantity,
  least(l_discount, 0.07::DOUBLE) AS l_discount, CASE WHEN l_linenumber = 1 THEN 0.0::DOUBLE ELSE l_tax END AS l_tax,
  CASE WHEN l_linenumber = 2 THEN 'O' ELSE l_linestatus END AS l_linestatus) FROM lineitem)"""
EV = "events"
EV8 = "(SELECT * REPLACE (value * 0.8 AS value) FROM events)"


def _ecdf_sql(src, syn, c):
    return f"""(SELECT x, sum(ca) OVER (ORDER BY x) / sum(ca) OVER () AS fa, sum(cb) OVER (ORDER BY x) / sum(cb) OVER () AS fb,
        sum(ca) OVER () AS na, sum(cb) OVER () AS nb FROM (
     SELECT x, sum(a) AS ca, sum(b) AS cb FROM (
       SELECT CAST({c} AS DOUBLE) AS x, 1 AS a, 0 AS b FROM {src} WHERE {c} IS NOT NULL
       UNION ALL SELECT CAST({c} AS DOUBLE), 0, 1 FROM {syn} WHERE {c} IS NOT NULL) GROUP BY x))"""


def _ks_sql(src, syn, c, x=None):
    x = x or c
    return (f"SELECT '{c}' AS column, round(max(abs(fa - fb)), 6) AS ks, CAST(max(na) AS BIGINT) AS n_src, "
            f"CAST(max(nb) AS BIGINT) AS n_syn FROM {_ecdf_sql(src, syn, x)}")


@register("ks_distance", _ks_sql(A, R, "l_extendedprice") + "\nUNION ALL\n" + _ks_sql(A, R, "l_quantity"))
def q_ks(spark, sf):
    a, r = _ar(spark, sf)
    return rounded(validate.ks(a, r, "l_extendedprice").unionByName(validate.ks(a, r, "l_quantity")))


@register("wasserstein", f"""
SELECT 'value' AS column, round(sum(abs(fa - fb) * (x_next - x)), 6) AS wasserstein
FROM (SELECT *, lead(x) OVER (ORDER BY x) AS x_next FROM {_ecdf_sql(EV, EV8, 'value')}) WHERE x_next IS NOT NULL""")
def q_wasserstein(spark, sf):
    return rounded(validate.wasserstein(*_ev(spark, sf), "value"))


_EDGES = ", ".join(str(i / 10) for i in range(1, 10))


@register("psi", f"""
WITH e AS (SELECT quantile_cont(value, [{_EDGES}]) AS edges FROM {EV}),
a AS (SELECT len(list_filter(edges, lambda q: q < value)) AS bin, count(*) AS ca FROM {EV}, e WHERE value IS NOT NULL GROUP BY 1),
b AS (SELECT len(list_filter(edges, lambda q: q < value)) AS bin, count(*) AS cb FROM {EV8}, e WHERE value IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(a.ca, 0) AS ca, coalesce(b.cb, 0) AS cb FROM a FULL JOIN b USING (bin)),
p AS (SELECT greatest(ca / sum(ca) OVER (), 1e-4) AS p, greatest(cb / sum(cb) OVER (), 1e-4) AS q FROM j)
SELECT 'value' AS column, round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""")
def q_psi(spark, sf):
    return rounded(validate.psi(*_ev(spark, sf), "value", bins=10))


def _shares_sql(src, syn, c):
    return f"""(SELECT coalesce(a.ca, 0) AS ca, coalesce(b.cb, 0) AS cb,
        coalesce(a.ca, 0) / sum(coalesce(a.ca, 0)) OVER () AS p, coalesce(b.cb, 0) / sum(coalesce(b.cb, 0)) OVER () AS q
   FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS ca FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) a
   FULL JOIN (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cb FROM {syn} WHERE {c} IS NOT NULL GROUP BY 1) b USING (v))"""


@register("tv_distance", f"SELECT 'l_discount' AS column, round(0.5 * sum(abs(p - q)), 6) AS tvd FROM {_shares_sql(A, R, 'l_discount')}")
def q_tvd(spark, sf):
    return rounded(validate.tvd(*_ar(spark, sf), "l_discount"))


@register("js_divergence", f"""
SELECT 'l_discount' AS column,
       round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END)
           + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 6) AS js
FROM {_shares_sql(A, R, 'l_discount')}""")
def q_js(spark, sf):
    return rounded(validate.js_divergence(*_ar(spark, sf), "l_discount"))


def _chi_sql(c):
    return f"""SELECT '{c}' AS column, round(sum((ca - ea) * (ca - ea) / ea + (cb - eb) * (cb - eb) / eb), 6) AS chi2,
       CAST(count(*) - 1 AS BIGINT) AS dof
FROM (SELECT ca, cb, (ca + cb) / (sum(ca) OVER () + sum(cb) OVER ()) * sum(ca) OVER () AS ea,
             (ca + cb) / (sum(ca) OVER () + sum(cb) OVER ()) * sum(cb) OVER () AS eb FROM {_shares_sql(A, R, c)})"""


@register("chi_square", _chi_sql("l_discount") + "\nUNION ALL\n" + _chi_sql("l_tax"))
def q_chi(spark, sf):
    a, r = _ar(spark, sf)
    return rounded(validate.chi_square(a, r, "l_discount").unionByName(validate.chi_square(a, r, "l_tax")))


def _prio(spark, sf, status):
    """Priorities by customer; for ``O`` with all urgent orders taken as high ones."""
    o, p = table(spark, sf, "orders"), F.col("o_orderpriority")
    p = F.when(p == "1-URGENT", "2-HIGH").otherwise(p) if status == "O" else p
    return o.groupBy("o_custkey").agg(F.collect_set(p).alias("priorities"))


def _prio_sql(status):
    p = "CASE WHEN o_orderpriority = '1-URGENT' THEN '2-HIGH' ELSE o_orderpriority END" if status == "O" else "o_orderpriority"
    return f"(SELECT o_custkey, list(DISTINCT {p}) AS priorities FROM orders GROUP BY o_custkey)"


@register("label_fidelity", f"""
WITH la AS (SELECT l, count(*) / (SELECT count(*) FROM {_prio_sql('F')}) AS p
            FROM (SELECT unnest(priorities) AS l FROM {_prio_sql('F')}) GROUP BY l),
lb AS (SELECT l, count(*) / (SELECT count(*) FROM {_prio_sql('O')}) AS q
       FROM (SELECT unnest(priorities) AS l FROM {_prio_sql('O')}) GROUP BY l),
dl AS (SELECT avg(abs(coalesce(p, 0) - coalesce(q, 0))) AS d FROM la FULL JOIN lb USING (l)),
sa AS (SELECT CAST(len(priorities) AS VARCHAR) AS v, count(*) AS ca FROM {_prio_sql('F')} GROUP BY 1),
sb AS (SELECT CAST(len(priorities) AS VARCHAR) AS v, count(*) AS cb FROM {_prio_sql('O')} GROUP BY 1),
jn AS (SELECT coalesce(ca, 0) / sum(coalesce(ca, 0)) OVER () AS p, coalesce(cb, 0) / sum(coalesce(cb, 0)) OVER () AS q
       FROM sa FULL JOIN sb USING (v)),
dn AS (SELECT 0.5 * sum(abs(p - q)) AS d FROM jn)
SELECT 'priorities' AS column, round(100 * (1 - 0.5 * ((SELECT d FROM dl) + sum(d))), 6) AS fidelity FROM dn""")
def q_label_fidelity(spark, sf):
    return rounded(validate.label_fidelity(_prio(spark, sf, "F"), _prio(spark, sf, "O"), "priorities"))


@register("uniqueness", """
SELECT 'o_custkey' AS column, round(count(DISTINCT o_custkey) / greatest(count(o_custkey), 1), 6) AS uniqueness FROM orders
UNION ALL
SELECT 'o_orderkey', round(count(DISTINCT o_orderkey) / greatest(count(o_orderkey), 1), 6) FROM orders""")
def q_uniqueness(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(validate.uniqueness(o, "o_custkey").unionByName(validate.uniqueness(o, "o_orderkey")))


def _nulled(spark, sf):
    c = table(spark, sf, "customer")
    return c, c.withColumn("c_acctbal", with_nulls(F.col("c_acctbal"), uniform(5, "null:c_acctbal", F.col("c_custkey")), 0.1))


_NULLED = (f"(SELECT * REPLACE (CASE WHEN {u_sql(5, 'null:c_acctbal', 'c_custkey')} >= 0.1 THEN c_acctbal END "
           f"AS c_acctbal) FROM customer)")


@register("null_parity", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column, round(a, 6) AS null_src, round(b, 6) AS null_syn, round(abs(a - b), 6) AS delta FROM
    (SELECT count(*) FILTER (WHERE {c} IS NULL) / count(*) AS a FROM customer),
    (SELECT count(*) FILTER (WHERE {c} IS NULL) / count(*) AS b FROM {_NULLED})"""
    for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def q_null_parity(spark, sf):
    return rounded(validate.null_parity(*_nulled(spark, sf)))


def _tail_sql(src, syn, c):
    s = lambda t: f"(SELECT quantile_cont({c}, 0.99) - quantile_cont({c}, 0.5) FROM {t})"
    return (f"SELECT '{c}' AS column, round({s(syn)} / {s(src)}, 6) AS tail_ratio, "
            f"CASE WHEN {s(syn)} / {s(src)} < 0.9 THEN '{validate.TAIL_NOTE}' END AS note")


@register("tail_compression", _tail_sql(EV, EV8, "value") + "\nUNION ALL\n" + _tail_sql(A, R, "l_extendedprice"))
def q_tail(spark, sf):
    a, r = _ar(spark, sf)
    return rounded(validate.tail_ratio(*_ev(spark, sf), "value")
                   .unionByName(validate.tail_ratio(a, r, "l_extendedprice")))


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("corr_drift", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(x, 6) AS r_src, round(y, 6) AS r_syn, round(abs(x - y), 6) AS delta "
    f"FROM (SELECT corr({a}, {b}) AS x FROM {A}), (SELECT corr({a}, {b}) AS y FROM {R})" for a, b in _pairs(LI_NUM)))
def q_corr_drift(spark, sf):
    return rounded(validate.corr_drift(*_ar(spark, sf), LI_NUM))


LI_TYPES = {"l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_linestatus": "enum",
            "l_shipdate": "date"}


def _status_sql(x):
    return f"CASE WHEN {x} >= 85 THEN 'pass' WHEN {x} >= 70 THEN 'warn' ELSE 'fail' END"


def _fidelity_rows_sql():
    rows = []
    for c, t in LI_TYPES.items():
        xc = f"epoch({c})" if t == "date" else c
        if t in ("float", "date"):
            score = f"100 * (1 - (SELECT max(abs(fa - fb)) FROM {_ecdf_sql(A, R, xc)}))"
            if t == "float":
                sp = lambda tb: f"(SELECT quantile_cont({c}, 0.99) - quantile_cont({c}, 0.5) FROM {tb})"
                note = f"CASE WHEN {sp(R)} / {sp(A)} < 0.9 THEN '{validate.TAIL_NOTE}' END"
            else:
                note = "NULL"
        else:
            score = f"100 * (1 - (SELECT 0.5 * sum(abs(p - q)) FROM {_shares_sql(A, R, c)}))"
            note = "NULL"
        rows.append(f"SELECT '{c}' AS column, {score} AS fidelity, {note} AS note")
    return "\nUNION ALL\n".join(rows)


@register("column_fidelity", f"""
SELECT "column", round(fidelity, 6) AS fidelity, {_status_sql('fidelity')} AS status, note
FROM ({_fidelity_rows_sql()})""")
def q_column_fidelity(spark, sf):
    return rounded(validate.column_fidelity(*_ar(spark, sf), LI_TYPES))


@register("realism", f"""
SELECT 'Realism' AS label, round(0.5 * (SELECT avg(fidelity) FROM ({_fidelity_rows_sql()}))
  + 0.5 * (100 - 100 * (SELECT max(abs(x - y)) FROM ({' UNION ALL '.join(
      f"SELECT x, y FROM (SELECT corr({a}, {b}) AS x FROM {A}), (SELECT corr({a}, {b}) AS y FROM {R})"
      for a, b in _pairs(LI_NUM))}))), 6) AS score""")
def q_realism(spark, sf):
    a, r = _ar(spark, sf)
    fid = validate.column_fidelity(a, r, LI_TYPES)
    return rounded(validate.realism(fid, validate.corr_drift(a, r, LI_NUM)))


def _div_parts_sql(c):
    ent = lambda p: f"sum(CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0 END)"
    return (f"(SELECT count(*) FILTER (WHERE ca > 0 AND cb > 0) / greatest(count(*) FILTER (WHERE ca > 0), 1) "
            f"FROM {_shares_sql(A, R, c)}) + (SELECT least(1.0, CASE WHEN {ent('p')} > 0 THEN {ent('q')} / {ent('p')} "
            f"ELSE 1.0 END) FROM {_shares_sql(A, R, c)})")


@register("diversity", f"""
SELECT 'Diversity' AS label, round(100 * ((SELECT count(*) FROM (SELECT DISTINCT * FROM {R})) / (SELECT count(*) FROM {R})
  + {_div_parts_sql('l_linestatus')} + {_div_parts_sql('l_discount')}) / 5, 6) AS score""")
def q_diversity(spark, sf):
    a, r = _ar(spark, sf)
    return rounded(validate.diversity(a, r, ["l_linestatus", "l_discount"]))


@register("duplicates", "SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def q_duplicates(spark, sf):
    d = validate.duplicates(table(spark, sf, "documents"), ["text"])
    return d.select(F.md5("text").alias("text_md5"), "copies")


_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE k >= 0.8::DOUBLE * (ca.n + cb.n - k) - 1e-9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS rep, EXISTS (SELECT 1 FROM l WHERE l.b = d.doc_id) AS near_dup
FROM documents d"""


@register("near_duplicates", _NEAR_SQL)
def q_near_duplicates(spark, sf):
    return validate.near_duplicates(table(spark, sf, "documents"), "doc_id", "text")


_EV_NO_ERR = "(SELECT * FROM events WHERE event_type <> 'error')"


@register("missing_categories", f"""
SELECT 'event_type' AS column, v AS value FROM (
  SELECT DISTINCT CAST(event_type AS VARCHAR) AS v FROM events WHERE event_type IS NOT NULL
  EXCEPT SELECT DISTINCT CAST(event_type AS VARCHAR) FROM {_EV_NO_ERR} WHERE event_type IS NOT NULL)
UNION ALL
SELECT 'user_id', v FROM (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS v FROM events WHERE user_id IS NOT NULL
  EXCEPT SELECT DISTINCT CAST(user_id AS VARCHAR) FROM {_EV_NO_ERR} WHERE user_id IS NOT NULL)""")
def q_missing(spark, sf):
    ev = table(spark, sf, "events")
    return validate.missing_categories(ev, ev.filter(F.col("event_type") != "error"), ["event_type", "user_id"])


@register("range_coverage", f"""
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
s AS (SELECT DISTINCT least(greatest(floor((value - lo) / ((hi - lo) / 20)) + 1, 1), 20) AS bin FROM events, b WHERE value IS NOT NULL),
y AS (SELECT DISTINCT least(greatest(floor((value - lo) / ((hi - lo) / 20)) + 1, 1), 20) AS bin FROM {EV8}, b WHERE value IS NOT NULL)
SELECT 'value' AS column, round((SELECT count(*) FROM s WHERE bin IN (SELECT bin FROM y)) / (SELECT count(*) FROM s), 6) AS coverage""")
def q_range_coverage(spark, sf):
    return rounded(validate.range_coverage(*_ev(spark, sf), "value"))


@register("pii_scan", "\nUNION ALL\n".join(
    f"SELECT '{k}' AS kind, 'text' AS column, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS rows, "
    f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) AS hits FROM documents"
    for k, p in validate.PII_PATTERNS.items()))
def q_pii_scan(spark, sf):
    return validate.pii_scan(table(spark, sf, "documents"), ["text"])


_LUHN = ("(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INTEGER) "
         "ELSE 2 * CAST(substr(d, i, 1) AS INTEGER) - CASE WHEN substr(d, i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0)")
_PII_SQL = "\nUNION ALL\n".join(
    f"SELECT '{k}' AS kind, 'text' AS column, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS rows, "
    f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) AS hits FROM documents"
    for k, p in validate.PII_PATTERNS.items())


@register("pii_scan_luhn", f"""{_PII_SQL}
UNION ALL SELECT 'card_luhn', 'text', count(*) FILTER (WHERE n > 0), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (
  SELECT len(list_filter(list_transform(regexp_extract_all(text, '{validate.PII_PATTERNS["card"]}'),
                                        lambda m: regexp_replace(m, '[ -]', '', 'g')), lambda d: {_LUHN})) AS n FROM documents)""")
def q_pii_scan_luhn(spark, sf):
    return validate.pii_scan(table(spark, sf, "documents"), ["text"], luhn=True)


def _mask_sql(col):
    e = col
    for kind, mask in validate.PII_MASKS:
        e = f"regexp_replace({e}, '{validate.PII_PATTERNS[kind]}', '{mask}', 'g')"
    return e


@register("pii_mask", f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents")
def q_pii_mask(spark, sf):
    return validate.pii_mask(table(spark, sf, "documents"), ["text"]).select("doc_id", "text")


@register("source_leak", """
SELECT item_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE d.text IS NOT DISTINCT FROM b.text)""")
def q_source_leak(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    bench = table(spark, sf, "benchmark")
    return validate.source_leak(docs, bench, ["text"]).select("item_id")


@register("nearest_source", f"""
WITH src AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS x, o_custkey AS y FROM orders),
st AS (SELECT stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM src),
ids AS (SELECT range AS syn_id FROM range((SELECT count(*) FROM orders))),
draw AS (SELECT syn_id, CAST(floor({u_sql(3, 'bootstrap', 'syn_id')} * (SELECT count(*) FROM orders)) AS BIGINT) AS pos FROM ids),
syn AS (SELECT syn_id, x + 0.1 * sx * {normal_sql(3, 'jitter:o_totalprice', 'syn_id')} AS x, y + 0.1 * sy * {normal_sql(3, 'jitter:o_custkey', 'syn_id')} AS y
        FROM draw JOIN src USING (pos), st)
SELECT syn_id, round(min(sqrt(((syn.x - src.x) / sx) * ((syn.x - src.x) / sx) + ((syn.y - src.y) / sy) * ((syn.y - src.y) / sy))), 6) AS distance
FROM syn, src, st GROUP BY syn_id""")
def q_nearest_source(spark, sf):
    from synthkit.operators.synth import smooth_bootstrap
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    syn = smooth_bootstrap(o, o.count(), "o_orderkey", ["o_totalprice", "o_custkey"], 0.1, seed=3)
    return rounded(validate.nearest_source(o, syn, ["o_totalprice", "o_custkey"], "syn_id"))


@register("status_of", f"""
SELECT source, round(100 * avg(quality), 6) AS score, {_status_sql('100 * avg(quality)')} AS status
FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def q_status_of(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    s = d.groupBy("source").agg((100 * F.avg("quality")).alias("score"))
    return rounded(s.withColumn("status", validate.status_of("score")))


# ------------------------------------------------------------------ report

_CONFORM = [{"name": "l_quantity", "type": "int"}, {"name": "l_tax", "type": "float"}, {"name": "l_shipdate", "type": "date"},
            {"name": "l_linestatus", "type": "enum", "dist": {"shares": [{"value": "O"}, {"value": "F"}]}},
            {"name": "l_returnflag", "type": "enum", "dist": {"shares": [{"value": "A"}, {"value": "N"}]}},
            {"name": "l_comment", "type": "text"}]
_CONFORM_BAD = {"l_quantity": "coalesce(l_quantity <> floor(l_quantity), true)", "l_tax": "l_tax IS NULL",
                "l_shipdate": "l_shipdate IS NULL", "l_linestatus": "coalesce(l_linestatus NOT IN ('O', 'F'), true)",
                "l_returnflag": "coalesce(l_returnflag NOT IN ('A', 'N'), true)", "l_comment": "true"}


@register("conformity", "\nUNION ALL\n".join(
    f"SELECT '{c['name']}' AS column, '{c['type']}' AS type, count(*) AS rows, count(*) FILTER (WHERE {_CONFORM_BAD[c['name']]}) AS failures, "
    f"count(*) FILTER (WHERE {_CONFORM_BAD[c['name']]}) = 0 AS ok FROM lineitem" for c in _CONFORM))
def q_conformity(spark, sf):
    return report.conformity(table(spark, sf, "lineitem"), _CONFORM)


_REPORT_TYPES = {"l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_linestatus": "enum", "l_shipdate": "date"}
_PII_HIT = (f"greatest(" + ", ".join(f"(SELECT count(*) FROM lineitem WHERE regexp_matches(l_linestatus, '{p}'))" for p in validate.PII_PATTERNS.values()) + ")")
_REALISM = f"""(0.5 * (SELECT avg(fidelity) FROM ({_fidelity_rows_sql()})) + 0.5 * (100 - 100 * {{drift}}))"""
_DRIFT3 = "(SELECT max(abs(x - y)) FROM (" + " UNION ALL ".join(
    f"SELECT x, y FROM (SELECT corr({a}, {b}) AS x FROM {A}), (SELECT corr({a}, {b}) AS y FROM {R})" for a, b in _pairs(LI_NUM[:3])) + "))"
_METRICS = f"""
SELECT 'Realism' AS label, {_REALISM.format(drift=_DRIFT3)} AS score
UNION ALL SELECT 'Diversity', 100 * ((SELECT count(*) FROM (SELECT DISTINCT * FROM {R})) / (SELECT count(*) FROM {R}) + {_div_parts_sql('l_linestatus')}) / 3
UNION ALL SELECT 'Safety / PII', 100.0 * (1 - {_PII_HIT} / (SELECT count(*) FROM {R}))"""
_VERDICT = f"""SELECT CASE status WHEN 'fail' THEN 'Not ready' WHEN 'warn' THEN 'Usable with caveats' ELSE 'Ready for fine-tuning' END AS verdict, status
FROM (SELECT CASE WHEN min(score) < 70 THEN 'fail' WHEN min(score) < 85 THEN 'warn' ELSE 'pass' END AS status FROM ({_METRICS}))"""
_INSIGHTS = f"""
SELECT 1 AS position, "column" || ' shows mild tail compression — consider increasing variance in generation params' AS insight
FROM ({_fidelity_rows_sql()}) WHERE note IS NOT NULL
UNION ALL SELECT 2, CASE WHEN hit = 0 THEN 'No PII detected across all ' || format('{{:,}}', (SELECT count(*) FROM lineitem)) || ' rows'
  ELSE 'PII found in ' || format('{{:,}}', hit) || ' rows' END FROM (SELECT {_PII_HIT} AS hit)
UNION ALL SELECT 3, 'Inter-column correlations preserved within ' || CAST(CAST(ceil(100 * d - 1e-9) AS BIGINT) AS VARCHAR) || '% of source statistics' FROM (SELECT {_DRIFT3} AS d)"""
_EDGE_REPORT = {"deep discount": ("l_discount >= 0.07", 20000)}


def _report(spark, sf):
    src, syn = _ar(spark, sf)
    return report.validate(src, syn, _REPORT_TYPES, ["l_linestatus"], _EDGE_REPORT)


@register("report_metrics", f"SELECT label, round(score, 6) AS score, {_status_sql('score')} AS status FROM ({_METRICS})")
def q_report_metrics(spark, sf):
    return rounded(_report(spark, sf)["metrics"])


@register("verdict", _VERDICT)
def q_verdict(spark, sf):
    return _report(spark, sf)["verdict"]


@register("insights", _INSIGHTS)
def q_insights(spark, sf):
    return _report(spark, sf)["insights"]


@register("validation_report", f"""
SELECT 'verdict' AS section, verdict AS name, CAST(NULL AS DOUBLE) AS score, status, CAST(NULL AS VARCHAR) AS text FROM ({_VERDICT})
UNION ALL SELECT 'metric', label, round(score, 6), {_status_sql('score')}, NULL FROM ({_METRICS})
UNION ALL SELECT 'column', "column", round(fidelity, 6), {_status_sql('fidelity')}, note FROM ({_fidelity_rows_sql()})
UNION ALL SELECT 'insight', NULL, NULL, NULL, insight FROM ({_INSIGHTS})
UNION ALL SELECT 'edge case', 'deep discount', round(100.0 * n / 20000, 1), NULL, CAST(n AS VARCHAR) || ' of 20000'
  FROM (SELECT count(*) AS n FROM {R} WHERE l_discount >= 0.07)""")
def q_validation_report(spark, sf):
    return rounded(report.long_form(_report(spark, sf)))


# ------------------------------------------------------------------ constraints

LI_RULES = [{"name": "qty_range", "expr": "l_quantity BETWEEN 1 AND 45"},
            {"name": "price_positive", "expr": "l_extendedprice > 0"},
            {"name": "discount_cap", "expr": "l_discount <= 0.08"}]


@register("violations", "\nUNION ALL\n".join(
    f"SELECT '{r['name']}' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT coalesce({r['expr']}, false)) AS failures, "
    f"round(count(*) FILTER (WHERE NOT coalesce({r['expr']}, false)) / greatest(count(*), 1), 6) AS share FROM lineitem"
    for r in LI_RULES))
def q_violations(spark, sf):
    return rounded(rules.violations(table(spark, sf, "lineitem"), LI_RULES))


@register("apply_constraints", """
SELECT l_orderkey, l_linenumber, least(greatest(l_discount, 0.02), 0.08) AS l_discount, l_quantity
FROM lineitem WHERE coalesce(l_quantity BETWEEN 1 AND 45, false)""")
def q_apply_constraints(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    out = rules.apply_constraints(li, [LI_RULES[0], {"name": "disc", "mode": "clamp", "column": "l_discount",
                                                     "lo": 0.02, "hi": 0.08}])
    return rounded(out)


EDGE = {"deep discount": ("l_discount >= 0.09", 5000), "bulk order": ("l_quantity > 45", 2000)}


@register("edge_coverage", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS description, CAST({r} AS BIGINT) AS requested, count(*) FILTER (WHERE coalesce({w}, false)) AS generated, "
    f"round(100.0 * count(*) FILTER (WHERE coalesce({w}, false)) / {r}, 1) AS coverage_pct FROM lineitem"
    for n, (w, r) in EDGE.items()))
def q_edge_coverage(spark, sf):
    return rules.edge_coverage(table(spark, sf, "lineitem"), EDGE)


@register("refine_spec", f"""
WITH p AS (SELECT avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sigma FROM lineitem)
SELECT id, round(mu + sigma * 1.5 * {normal_sql(0, 'qty', 'id')}, 6) AS qty FROM (SELECT range AS id FROM range((SELECT count(*) FROM lineitem))), p""")
def q_refine_spec(spark, sf):
    li = table(spark, sf, "lineitem")
    st = li.agg(F.avg("l_quantity").alias("mu"), F.stddev("l_quantity").alias("sigma"), F.count(F.lit(1)).alias("n")).first()
    spec = {"rows": st["n"], "seed": 0, "columns": [
        {"name": "l_quantity", "type": "float", "spark_type": "double",
         "dist": {"family": "gaussian", "mu": st["mu"], "sigma": st["sigma"]}}]}
    spec2 = refine(spec, {"scale": {"l_quantity": {"sigma": 1.5}}, "rename": {"l_quantity": "qty"}})
    return rounded(synthesize(spark, spec2))


@register("synthesize", f"""
WITH p AS (SELECT avg(l_quantity) AS mu, stddev_samp(l_quantity) AS sigma, count(*) AS n FROM lineitem),
g AS (SELECT id, mu + sigma * {normal_sql(4, 'l_quantity', 'id')} AS q FROM (SELECT range AS id FROM range((SELECT 3 * n FROM p))), p)
SELECT id, round(q, 6) AS l_quantity FROM g WHERE q BETWEEN 1 AND 50 ORDER BY id LIMIT (SELECT count(*) FROM lineitem)""")
def q_synthesize(spark, sf):
    """As many rows as lineitem has, all within the constraint."""
    li = table(spark, sf, "lineitem")
    st = li.agg(F.avg("l_quantity").alias("mu"), F.stddev("l_quantity").alias("sigma"), F.count(F.lit(1)).alias("n")).first()
    spec = {"rows": st["n"], "seed": 4, "constraints": ["l_quantity BETWEEN 1 AND 50"], "columns": [
        {"name": "l_quantity", "type": "float", "spark_type": "double", "dist": {"family": "gaussian", "mu": st["mu"], "sigma": st["sigma"]}}]}
    rows, _ = rules.synthesize_checked(spark, spec)
    return rounded(rows)


@register("edge_cases")
def q_edge_cases(spark, sf):
    """Rows meeting a rare predicate, generated from the spec inferred from lineitem."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    spec = infer_spec(li)
    want = li.filter("l_quantity > 45 AND l_discount >= 0.09").count()
    rows, _report = rules.edge_cases(spark, spec, "l_quantity > 45 AND l_discount >= 0.09", want)
    return rows
