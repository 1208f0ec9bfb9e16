"""The validation report: conformity, the three metrics, verdict, insights, and all of it in long form.

Scores and texts follow the product's report; formulas are ours.  The report
reads each side a fixed number of times, whatever the number of findings; all
its tables are small (a row per column, metric or sentence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthkit.operators import validate as v
from synthkit.operators.profile import UUID_PATTERN, _one_row_unpivot


def conformity(df: DataFrame, columns: list[dict]) -> DataFrame:
    """Rows that break the schema, per column of a spec → (column, type, rows, failures, ok).

    Checked in one aggregate: numbers that do not parse (int, float) or are not whole (int), dates that
    do not parse, uuids of another shape (a prefix is allowed), enum values
    outside the spec's shares, labels outside its vocabulary.  Nulls conform
    where the spec has a null rate.  A column that is missing fails in all rows.
    """
    specs, have = {}, set(df.columns)
    for c in columns:
        name, kind, d = c["name"], c["type"], c.get("dist", {})
        if name not in have:
            specs[name] = [("rows", F.count(F.lit(1)), "bigint"), ("failures", F.count(F.lit(1)), "bigint")]
            continue
        x = F.col(f"`{name}`")
        text = x.cast("string")
        if kind == "int":
            ok = text.try_cast("double") == F.floor(text.try_cast("double"))
        elif kind == "float":
            ok = text.try_cast("double").isNotNull()
        elif kind == "date":
            ok = text.try_cast("timestamp").isNotNull()
        elif kind == "uuid":
            ok = F.regexp_replace(text, "^" + d.get("prefix", ""), "").rlike(UUID_PATTERN) if d.get("family") == "uuid" else F.lit(True)
        elif kind == "enum":
            ok = text.isin([str(s["value"]) for s in d.get("shares", [])])
        elif kind == "array<str>":
            known = F.array(*[F.lit(str(s["value"])) for s in d.get("shares", [])]).cast("array<string>")
            ok = F.size(F.array_except(x, known)) == 0
        else:
            ok = F.lit(True)
        allowed = F.lit(float(c.get("null_rate") or 0) > 0)
        bad = F.when(x.isNull(), ~allowed).otherwise(~F.coalesce(ok, F.lit(False)))
        specs[name] = [("rows", F.count(F.lit(1)), "bigint"), ("failures", F.count_if(bad), "bigint")]
    kinds = F.create_map(*[F.lit(t) for c in columns for t in (c["name"], c["type"])])
    return _one_row_unpivot(df, specs).select("column", kinds[F.col("column")].alias("type"), "rows", "failures",
                                              (F.col("failures") == 0).alias("ok"))


def safety(scan: DataFrame, rows) -> DataFrame:
    """Metric ``Safety / PII``: 100 x the share of rows without a finding, by the kind and column with most rows."""
    worst = scan.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("hit"))
    return worst.select(F.lit(v.SAFETY_LABEL).alias("label"), (100.0 * (1 - F.col("hit") / F.greatest(rows, F.lit(1)))).alias("score"))


def verdict(metrics: DataFrame) -> DataFrame:
    """(verdict, status) from the metrics alone: a column that warns does not lower it."""
    fails = F.count_if(F.col("status") == "fail")
    warns = F.count_if(F.col("status") == "warn")
    status = F.when(fails > 0, "fail").when(warns > 0, "warn").otherwise("pass")
    return metrics.agg(status.alias("status")).select(
        F.when(F.col("status") == "fail", v.VERDICT_FAIL).when(F.col("status") == "warn", v.VERDICT_WARN)
        .otherwise(v.VERDICT_PASS).alias("verdict"), "status")


def insights(columns: DataFrame, scan: DataFrame, drift: DataFrame | None, rows) -> DataFrame:
    """One sentence per compressed tail, one on personal data, one on correlations → (position, insight)."""
    tail_before, tail_after = v.TAIL_INSIGHT.split("{col}")
    tails = columns.where(F.col("note") == v.TAIL_NOTE).select(F.lit(1).alias("position"), F.concat(
        F.lit(tail_before), F.col("column"), F.lit(tail_after)).alias("insight"))
    found = scan.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("hit"))

    def sentence(template, count):
        before, after = template.split("{rows}")
        return F.concat(F.lit(before), F.format_number(count, 0), F.lit(after))

    out = tails.unionByName(found.select(F.lit(2).alias("position"), F.when(
        F.col("hit") == 0, sentence(v.PII_NONE_INSIGHT, rows)).otherwise(sentence(v.PII_FOUND_INSIGHT, F.col("hit"))).alias("insight")))
    if drift is not None:
        before, after = v.CORR_INSIGHT.split("{pct}")
        pct = F.ceil(100 * F.coalesce(F.max("delta"), F.lit(0.0)) - 1e-9).cast("string")
        out = out.unionByName(drift.agg(F.concat(F.lit(before), pct, F.lit(after)).alias("insight")).select(F.lit(3).alias("position"), "insight"))
    return out


def validate(src: DataFrame, syn: DataFrame, types: dict[str, str], text_cols: list[str],
             edge_cases: dict[str, tuple[str, int]] | None = None) -> dict[str, DataFrame]:
    """The whole report: metrics, columns, edge_cases, insights, verdict."""
    from synthkit.operators.rules import edge_coverage
    columns = v.column_fidelity(src, syn, types)
    numbers = [c for c, t in types.items() if t in ("int", "float")]
    drift = v.corr_drift(src, syn, numbers) if len(numbers) > 1 else None
    rows = syn.agg(F.count(F.lit(1))).scalar()
    scan = (v.pii_scan(syn, text_cols) if text_cols else
            syn.sparkSession.createDataFrame([], "kind string, column string, rows bigint, hits bigint"))
    scored = (v.realism(columns, drift)
              .unionByName(v.diversity(src, syn, [c for c, t in types.items() if t == "enum"]))
              .unionByName(safety(scan, rows)))
    metrics = scored.select("label", "score", v.status_of("score").alias("status"))
    out = {"metrics": metrics, "columns": columns, "insights": insights(columns, scan, drift, rows), "verdict": verdict(metrics)}
    if edge_cases:
        out["edge_cases"] = edge_coverage(syn, edge_cases)
    return out


def long_form(report: dict[str, DataFrame]) -> DataFrame:
    """(section, name, score, status, text): the report as one table."""
    null = F.lit(None).cast("string")
    parts = [
        report["verdict"].select(F.lit("verdict").alias("section"), F.col("verdict").alias("name"), F.lit(None).cast("double").alias("score"),
                                 "status", null.alias("text")),
        report["metrics"].select(F.lit("metric").alias("section"), F.col("label").alias("name"), "score", "status", null.alias("text")),
        report["columns"].select(F.lit("column").alias("section"), F.col("column").alias("name"), F.col("fidelity").alias("score"),
                                 "status", F.col("note").alias("text")),
        report["insights"].select(F.lit("insight").alias("section"), F.lit(None).cast("string").alias("name"),
                                  F.lit(None).cast("double").alias("score"), null.alias("status"), F.col("insight").alias("text"))]
    if "edge_cases" in report:
        parts.append(report["edge_cases"].select(
            F.lit("edge case").alias("section"), F.col("description").alias("name"), F.col("coverage_pct").alias("score"), null.alias("status"),
            F.concat_ws(" of ", F.col("generated").cast("string"), F.col("requested").cast("string")).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
