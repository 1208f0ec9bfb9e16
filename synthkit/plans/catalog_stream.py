"""Registered queries: streams (T1-T6) and sources/sinks (S1-S10, K1-K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthkit.operators.profile import quantiles
from synthkit.plans.registry import register, rounded, table
from synthkit.session import scratch_dir
from synthkit.sources import readers, sinks
from synthkit.streaming import stream
from synthkit.streaming.late import LateRows

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
CONV_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def _events(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # event time is cast ntz → timestamp
    return stream.events_stream(spark, sf, EVENTS_SCHEMA, glob="events.parquet")


def _tscol(c):
    return F.col(c).cast("string")


@register("stream_profile", """
SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS VARCHAR) AS window_end,
       event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events GROUP BY date_trunc('day', ts), event_type""")
def q_stream_profile(spark, sf):
    out, _ = stream.run_to_table(stream.stream_profile(_events(spark, sf), "ts", "event_type", "value"), "profile", keys=["window_start", "event_type"])
    return rounded(out.select(_tscol("window_start").alias("window_start"), _tscol("window_end").alias("window_end"),
                              "event_type", "n", "mean", "min", "max"))


@register("stream_sliding", """
WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, value FROM events
           UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY, event_type, value FROM events)
SELECT CAST(d AS VARCHAR) AS window_start, CAST(d + INTERVAL 2 DAY AS VARCHAR) AS window_end, event_type, count(*) AS n,
       round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max
FROM w GROUP BY d, event_type""")
def q_stream_sliding(spark, sf):
    out, _ = stream.run_to_table(stream.stream_sliding(_events(spark, sf), "ts", "event_type", "value"), "sliding", keys=["window_start", "event_type"])
    return rounded(out.select(_tscol("window_start").alias("window_start"), _tscol("window_end").alias("window_end"),
                              "event_type", "n", "mean", "min", "max"))


@register("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                                      OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR
                                    THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS session_start, CAST(max(ts) + INTERVAL 6 HOUR AS VARCHAR) AS session_end,
       count(*) AS n
FROM s GROUP BY user_id, sid""")
def q_stream_sessions(spark, sf):
    out, _ = stream.sessions_so_far(_events(spark, sf), "ts", "user_id")
    return out.select("user_id", _tscol("session_start").alias("session_start"),
                      _tscol("session_end").alias("session_end"), "n")


@register("late_rows", """
SELECT event_type, count(*) AS late FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY event_type""")
def q_late_rows(spark, sf):
    """Every event older than three days is delivered again, a kind at a time, after the watermark (one day) has passed it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = table(spark, sf, "events")
    newest = ev.agg(F.max("ts") - F.expr("INTERVAL 3 DAYS")).first()[0]
    path, found = scratch_dir(spark, "late-events"), []
    ev.write.parquet(path)
    folders = {"out": scratch_dir(spark, "late-out"), "checkpoint": scratch_dir(spark, "late-ckpt")}
    src = stream.stream_dedup(stream.events_stream(spark, path, EVENTS_SCHEMA), ["event_id"], "ts")
    with LateRows(spark, scratch_dir(spark, "late-counts")) as late:
        before = late.total(stream.run_to_table(src, **folders)[1])
        for kind in sorted(r[0] for r in ev.select("event_type").distinct().collect()):  # an enum of the events
            ev.where((F.col("ts") < F.lit(newest)) & (F.col("event_type") == kind)).write.mode("append").parquet(path)
            total = late.total(stream.run_to_table(src, **folders)[1])
            found.append((kind, total - before))
            before = total
    return spark.createDataFrame([f for f in found if f[1]], "event_type string, late bigint")


@register("stream_dedup", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def q_stream_dedup(spark, sf):
    """Deliveries are repeated by the transport: the event id is the key."""
    out, _ = stream.run_to_table(stream.stream_dedup(_events(spark, sf), ["event_id"], "ts"), "dedup")
    return out.select("event_id", "user_id", "event_type")


_EDGES = ", ".join(str(i / 10) for i in range(1, 10))


@register("stream_drift", f"""
WITH e AS (SELECT quantile_cont(value * 0.8, [{_EDGES}]) AS edges FROM events),
base AS (SELECT len(list_filter(edges, lambda q: q < value * 0.8)) AS bin, count(*) / sum(count(*)) OVER () AS p
         FROM events, e WHERE value IS NOT NULL GROUP BY 1),
cur AS (SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS w, len(list_filter(edges, lambda q: q < value)) AS bin, count(*) AS c
        FROM events, e WHERE value IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT w, sum(c) AS n FROM cur GROUP BY w),
j AS (SELECT w, n, greatest(coalesce(p, 0), 1e-4) AS p, greatest(coalesce(c, 0) / n, 1e-4) AS q
      FROM tot CROSS JOIN (SELECT range AS bin FROM range(10)) LEFT JOIN base USING (bin) LEFT JOIN cur USING (w, bin))
SELECT CAST(w AS VARCHAR) AS window_start, round(sum((q - p) * ln(q / p)), 6) AS psi, CAST(max(n) AS BIGINT) AS rows FROM j GROUP BY w""")
def q_stream_drift(spark, sf):
    base = table(spark, sf, "events").select((F.col("value") * 0.8).alias("value"))
    edges = [r["value"] for r in quantiles(base, ["value"], [i / 10 for i in range(1, 10)]).orderBy("prob").collect()]
    arr = F.array(*[F.lit(float(e)) for e in edges])
    counts = {r["bin"]: r["c"] for r in base.filter(F.col("value").isNotNull())
              .groupBy(F.size(F.filter(arr, lambda e: e < F.col("value"))).alias("bin"))
              .agg(F.count(F.lit(1)).alias("c")).collect()}  # ≤ 10 bins
    total = sum(counts.values())
    shares = [counts.get(i, 0) / total for i in range(10)]
    counts, _ = stream.run_to_table(stream.stream_drift(_events(spark, sf), "ts", "value", edges), "drift", keys=["window_start", "bin"])
    return rounded(stream.drift_of(counts, shares).withColumn("window_start", _tscol("window_start")))


def _pii_case(col):
    from synthkit.operators.validate import PII_PATTERNS
    parts = ", ".join(f"CASE WHEN regexp_matches({col}, '{p}') THEN '{k}' END" for k, p in PII_PATTERNS.items())
    return f"concat_ws(',', {parts})"


@register("stream_pii", f"""
SELECT conv_id, turn, {_pii_case('text')} AS pii FROM conversations WHERE {_pii_case('text')} <> ''""")
def q_stream_pii(spark, sf):
    sdf = stream.events_stream(spark, sf, CONV_SCHEMA, ts=None, glob="conversations.parquet")
    out, _ = stream.run_to_table(stream.stream_pii(sdf, ["text"]), "pii")
    return out.select("conv_id", "turn", "pii")


# ------------------------------------------------------------------ sources and sinks

@register("read_parquet", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem")
def q_read_parquet(spark, sf):
    li = readers.read_parquet(spark, f"{sf}/lineitem.parquet")
    return rounded(li.select("l_orderkey", "l_linenumber", "l_extendedprice"))


@register("read_csv", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def q_read_csv(spark, sf):
    path = scratch_dir(spark, "csv")
    sinks.write_csv(table(spark, sf, "customer"), path)
    back = readers.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                                          "c_mktsegment string")
    return rounded(back)


@register("write_table", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders")
def q_write_table(spark, sf):
    path = scratch_dir(spark, "table")
    sinks.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path,
                      partition_by=["o_orderstatus"])
    return rounded(spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice"))


@register("export_manifest")
def q_export_manifest(spark, sf):
    return sinks.export_manifest(table(spark, sf, "customer"), scratch_dir(spark, "export"))


@register("read_export_wiki", r"""
SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
       trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
            '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
            '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text
FROM pages""")
def q_read_export_wiki(spark, sf):
    return readers.read_export(spark, "wiki", f"{sf}/pages.parquet")


@register("read_export_chat", "SELECT conv_id, turn, role, text FROM conversations")
def q_read_export_chat(spark, sf):
    return readers.read_export(spark, "chat", f"{sf}/conversations.parquet")


@register("read_export_drive", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_read_export_drive(spark, sf):
    return readers.read_export(spark, "drive", f"{sf}/documents.parquet")


_ALL = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()


@register("scan_sources", "\nUNION ALL\n".join(f"SELECT '{t}' AS source, count(*) AS rows FROM {t}" for t in _ALL))
def q_scan_sources(spark, sf):
    prof = [{"name": t, "path": f"{sf}/{t}.parquet", "enabled": True} for t in _ALL]
    prof.append({"name": "disabled_source", "path": f"{sf}/nowhere.parquet", "enabled": False})
    return readers.source_counts(readers.scan_sources(spark, prof))


@register("scan_sources_files", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS source, '{t}.parquet' AS file, count(*) AS rows FROM {t}" for t in _ALL))
def q_scan_sources_files(spark, sf):
    """Where the rows come from: every source is read from the folder by a name filter, each row keeps its file.
    A table that is a folder of part files counts as one."""
    prof = [{"name": t, "path": sf, "glob": f"{t}.parquet"} for t in _ALL]
    return readers.file_counts(readers.scan_sources(spark, prof), root=sf)


@register("file_inventory", """
SELECT regexp_extract(filename, '([^/]+)$', 1) AS name, size,
       CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B'
            WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024.0, 1))
            ELSE printf('%.1f MB', round(size / 1048576.0, 1)) END AS size_text, 'Grounding' AS badge
FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
def q_file_inventory(spark, sf):
    return readers.file_inventory(spark, sf, glob="*.parquet")
