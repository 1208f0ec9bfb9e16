"""Registered queries: row operations (O1-O11) and sampling (A1-A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthkit.functions.text import format_bytes, shorten, slugify
from synthkit.operators import rowops, sampling
from synthkit.plans.registry import register, rounded, table, u_sql


@register("select_enabled", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def q_select_enabled(spark, sf):
    return rowops.select_enabled(table(spark, sf, "labels"), F.col("quality") == 1, ["doc_id", "toxic"])


@register("search_rows", "SELECT p_partkey, p_name FROM part WHERE strpos(lower(p_name), 'ring') > 0")
def q_search_rows(spark, sf):
    return rowops.search_rows(table(spark, sf, "part"), "p_name", "Ring").select("p_partkey", "p_name")


@register("ranked_sort", """
SELECT c_custkey, CAST(row_number() OVER (
         ORDER BY (c_acctbal > 5000) DESC,
                  CASE WHEN c_acctbal > 5000 THEN coalesce(nullif(c_nationkey, 0), 0) END ASC NULLS LAST,
                  c_custkey) AS BIGINT) AS position
FROM customer""")
def q_ranked_sort(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.nullif(F.col("c_nationkey"), F.lit(0)).alias("connected_order"))
    out = rowops.ranked_sort(c, F.col("c_acctbal") > 5000, "connected_order", "c_custkey",
                             position="position")
    return out.select("c_custkey", "position")


@register("list_summary", """
WITH r AS (
  SELECT c_nationkey, c_name,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rn,
         count(*) OVER (PARTITION BY c_nationkey) AS n
  FROM customer)
SELECT c_nationkey, CAST(n AS BIGINT) AS n,
       CASE WHEN n > 2 THEN string_agg(c_name, ', ' ORDER BY c_name) || ' +' || CAST(n - 2 AS VARCHAR) || ' more'
            ELSE string_agg(c_name, ', ' ORDER BY c_name) END AS summary
FROM r WHERE rn <= 2 GROUP BY c_nationkey, n""")
def q_list_summary(spark, sf):
    return rowops.list_summary(table(spark, sf, "customer"), "c_nationkey", "c_name", k=2)


@register("list_summary_groups", f"""
WITH c AS (SELECT c_nationkey, c_name FROM customer WHERE c_acctbal > 9800),
r AS (SELECT n_nationkey, c_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_name) AS rn,
             count(c_name) OVER (PARTITION BY n_nationkey) AS n
      FROM nation LEFT JOIN c ON c_nationkey = n_nationkey)
SELECT n_nationkey AS c_nationkey, n,
       CASE WHEN n = 0 THEN '{rowops.EMPTY_LIST_PHRASE}'
            WHEN n > 2 THEN string_agg(c_name, ', ' ORDER BY c_name) || ' +' || CAST(n - 2 AS VARCHAR) || ' more'
            ELSE string_agg(c_name, ', ' ORDER BY c_name) END AS summary
FROM r WHERE rn <= 2 GROUP BY n_nationkey, n""")
def q_list_summary_groups(spark, sf):
    """Customers with a high balance in every nation, nations without one included."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return rowops.list_summary(table(spark, sf, "customer").where("c_acctbal > 9800"), "c_nationkey", "c_name", k=2, groups=nations)


@register("lookup_or_first", """
WITH b AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'),
     f AS (SELECT c_custkey, c_name FROM b ORDER BY c_custkey LIMIT 1)
SELECT o.o_orderkey, o.o_custkey,
       CASE WHEN b.c_custkey IS NULL THEN f.c_custkey ELSE b.c_custkey END AS c_custkey,
       CASE WHEN b.c_custkey IS NULL THEN f.c_name ELSE b.c_name END AS c_name
FROM orders o LEFT JOIN b ON o.o_custkey = b.c_custkey CROSS JOIN f""")
def q_lookup_or_first(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")
    return rowops.lookup_or_first(keys, cust, "c_custkey", "c_custkey", key_in_keys="o_custkey")


@register("patch_rows", """
SELECT c.c_custkey, c.c_name, c.c_nationkey,
       round(coalesce(p.c_acctbal, c.c_acctbal), 6) AS c_acctbal,
       coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c
LEFT JOIN (SELECT c_custkey, 'AUTOMOBILE' AS c_mktsegment, c_acctbal + 100 AS c_acctbal
           FROM customer WHERE c_nationkey = 3) p ON c.c_custkey = p.c_custkey""")
def q_patch_rows(spark, sf):
    cust = table(spark, sf, "customer")
    patch = cust.filter(F.col("c_nationkey") == 3).select(
        "c_custkey", F.lit("AUTOMOBILE").alias("c_mktsegment"), (F.col("c_acctbal") + 100).alias("c_acctbal"))
    return rounded(rowops.patch_rows(cust, patch, "c_custkey"))


@register("stage_status", """
WITH last AS (
  SELECT user_id, event_type AS current FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1),
stages AS (SELECT DISTINCT user_id, event_type AS stage FROM events),
st AS (
  SELECT s.user_id, s.stage, l.current,
         CASE WHEN s.stage < l.current THEN 'done' WHEN s.stage = l.current THEN 'running' ELSE 'queued' END AS status
  FROM stages s JOIN last l USING (user_id))
SELECT user_id, stage, status, current,
       CAST(count(*) FILTER (WHERE status = 'done') OVER (PARTITION BY user_id) AS BIGINT) AS n_done,
       bool_and(status = 'done') OVER (PARTITION BY user_id) AS all_done
FROM st""")
def q_stage_status(spark, sf):
    return rowops.stage_status(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@register("append_rows", """
SELECT conv_id, turn, role, text FROM conversations
UNION ALL
SELECT conv_id, max(turn) + 1 AS turn, 'assistant' AS role, NULL AS text FROM conversations GROUP BY conv_id""")
def q_append_rows(spark, sf):
    conv = table(spark, sf, "conversations")
    pending = conv.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("assistant"))
    return rowops.append_rows(conv, pending).select("conv_id", "turn", "role", "text")


@register("format_bytes", """
SELECT doc_id, n_chars,
       CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || ' B'
            WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0, 1))
            ELSE printf('%.1f MB', round(n_chars / 1048576.0, 1)) END AS size_text
FROM documents""")
def q_format_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars", format_bytes("n_chars").alias("size_text"))


@register("slugify", r"""
SELECT p_partkey, coalesce(nullif(regexp_replace(lower(p_name), '\s+', '-', 'g'), ''), 'profile') AS slug
FROM part""")
def q_slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", slugify("p_name").alias("slug"))


@register("drop_blank", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')")
def q_drop_blank(spark, sf):
    return rowops.drop_blank(table(spark, sf, "documents"), "text").select("doc_id")


# ------------------------------------------------------------------ sampling

@register("hash_sample", f"""
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders
WHERE {u_sql(7, 'sample', 'o_orderkey')} < 0.1""")
def q_hash_sample(spark, sf):
    return rounded(sampling.hash_sample(table(spark, sf, "orders"), "o_orderkey", 0.1, seed=7)
                   .select("o_orderkey", "o_totalprice"))


@register("stratified_sample", f"""
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus
                               ORDER BY {u_sql(11, 'strata', 'row_key')}, row_key) AS rn
  FROM (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS row_key FROM lineitem))
WHERE rn <= 100""")
def q_stratified_sample(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    s = sampling.stratified_sample(li, ["l_returnflag", "l_linestatus"], 100, "row_key", seed=11)
    return s.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@register("sample_n", f"""
SELECT o_orderkey FROM orders ORDER BY {u_sql(3, 'sample_n', 'o_orderkey')}, o_orderkey LIMIT 50""")
def q_sample_n(spark, sf):
    return sampling.sample_n(table(spark, sf, "orders"), "o_orderkey", 50, seed=3).select("o_orderkey")


_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("sample_value", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, arg_min(CAST({c} AS VARCHAR), {u_sql(0, 'sample_value', f'CAST({c} AS VARCHAR)')}) "
    f"AS sample FROM customer WHERE {c} IS NOT NULL" for c in _CUST))
def q_sample_value(spark, sf):
    return sampling.sample_value(table(spark, sf, "customer"), _CUST, seed=0)


@register("shorten", """
SELECT c_custkey, CASE WHEN length(c_name) > 8 THEN substr(c_name, 1, 5) || '…' || right(c_name, 2)
                       ELSE c_name END AS short_name FROM customer""")
def q_shorten(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", shorten("c_name", 5, 2).alias("short_name"))
