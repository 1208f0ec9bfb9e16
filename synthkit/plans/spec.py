"""The synthesis spec: a plain dict (JSON-able) that replaces the product's prose prompt.

``{rows, seed, mode, columns: [{name, type, spark_type, dist: {family, ...}, null_rate}],
corr: [[a, b, rho]], constraints: [sql], edge_cases: [{name, where, rows}]}``

:func:`infer_spec` fills it from a source table.  The driver only receives
per-column parameters (at most ``enum_max`` shares per column and a k×k
correlation), never rows.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.operators.copula import fit_copula
from synthkit.operators.profile import fit_multilabel
from synthkit.operators.schema import profile_table

# The product's cohort (column, type, distribution) — parameters the mock-up leaves
# unstated (hba1c σ, label shares, exact date bounds) are ours.
COHORT_SPEC = {
    "rows": 10000, "seed": 7, "mode": "md5",
    "columns": [
        {"name": "patient_id", "type": "uuid", "spark_type": "string", "dist": {"family": "uuid", "prefix": "pt_"}},
        {"name": "age", "type": "int", "spark_type": "bigint", "dist": {"family": "gaussian", "mu": 52, "sigma": 8}},
        {"name": "sex", "type": "enum", "spark_type": "string",
         "dist": {"family": "category", "shares": [{"value": "F", "share": 0.52}, {"value": "M", "share": 0.48}]}},
        {"name": "hba1c", "type": "float", "spark_type": "double",
         "dist": {"family": "lognormal", "mu_log": 1.9, "sigma_log": 0.3}},
        {"name": "comorbidities", "type": "array<str>", "spark_type": "array<string>",
         "dist": {"family": "multilabel", "shares": [{"value": "HTN", "share": 0.45}, {"value": "CKD", "share": 0.2},
                                                     {"value": "CAD", "share": 0.15}, {"value": "COPD", "share": 0.1}]}},
        {"name": "last_visit", "type": "date", "spark_type": "date",
         "dist": {"family": "uniform", "lo_date": "2023-01-01", "hi_date": "2025-12-31"}},
    ],
    "edge_cases": [{"name": "HbA1c > 12 + 3+ comorbidities",
                    "where": "hba1c > 12 AND size(comorbidities) >= 3", "rows": 500}],
}


def infer_spec(df: DataFrame, rows: int | None = None, seed: int = 0, mode: str = "md5",
               enum_max: int = 50, with_corr: bool = True, key: str | None = None, drop: tuple[str, ...] = ()) -> dict:
    """Profile ``df`` and turn the per-column fits into a spec (one small collect).

    Numbers, dates and enums are linked by a Gaussian copula unless ``with_corr`` is off (``key`` is not needed any
    more).  Text and nested columns cannot be generated: they must be listed under ``drop``.
    """
    df = df.drop(*drop)
    prof = profile_table(df, seed=seed, enum_max=enum_max)
    day_checks = [F.count_if(F.col(f.name) != F.date_trunc("day", F.col(f.name))).alias(f.name)
                  for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    aggs = [F.count(F.lit(1)).alias("_rows")] + day_checks
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            aggs += [F.min(F.to_date(f.name)).cast("string").alias("_lo_" + f.name),
                     F.max(F.to_date(f.name)).cast("string").alias("_hi_" + f.name)]
    extra = df.agg(*aggs).first()
    cols = []
    for r in sorted(prof.collect(), key=lambda r: df.columns.index(r["column"])):
        name, typ, st = r["column"], r["type"], r["spark_type"]
        total = (r["n"] or 0) + (r["nulls"] or 0)
        col = {"name": name, "type": typ, "spark_type": st,
               "null_rate": (r["nulls"] / total) if total else 0.0}
        if typ == "uuid":
            col["dist"] = {"family": "uuid", "prefix": ""}
        elif typ == "int" and r["is_unique"]:
            col["dist"] = {"family": "sequence", "lo": int(r["lo"])}
        elif typ == "enum":
            col["dist"] = {"family": "category",
                           "shares": [{"value": s["value"], "share": s["share"]} for s in r["shares"] or []]}
        elif typ in ("int", "float"):
            col["dist"] = {"family": r["family"], "mu": r["mu"], "sigma": r["sigma"], "mu_log": r["mu_log"],
                           "sigma_log": r["sigma_log"], "rate": r["rate"], "lo": r["lo"], "hi": r["hi"]}
        elif typ == "date":
            whole_days = st == "date" or extra[name] == 0
            col["dist"] = {"family": "uniform", "lo": r["lo"], "hi": r["hi"], "unit": "day" if whole_days else "micro",
                           "lo_date": extra["_lo_" + name], "hi_date": extra["_hi_" + name]}
        elif typ == "array<str>":
            shares, lengths = fit_multilabel(df, name)
            top = shares.orderBy(F.desc("rows"), "label").collect()  # the label vocabulary is part of the spec
            col["dist"] = {"family": "multilabel", "shares": [{"value": s["label"], "share": s["share"]} for s in top],
                           "lengths": [{"labels": s["labels"], "share": s["share"]} for s in lengths.orderBy("labels").collect()]}
        else:  # free text / nested values: no generative model in the product
            raise ValueError(f"column {name} holds {typ} values, which no spec can generate: list it under drop, "
                             "or resample whole rows with bootstrap")
        cols.append(col)
    spec = {"rows": int(rows if rows is not None else extra["_rows"]), "seed": seed, "mode": mode,
            "columns": cols, "skipped": list(drop), "corr": [], "corr_kind": "latent"}
    if with_corr:
        spec["corr"] = fit_copula(df, cols)
    return spec


def refine(spec: dict, changes: dict) -> dict:
    """Apply user refinements to a spec (returns a new dict).

    ``changes``: ``rename {old: new}``, ``drop [names]``, ``retype {name: (type, spark_type)}``,
    ``params {name: {param: value}}``, ``scale {name: {param: factor}}`` (e.g. widen sigma),
    ``rows``, ``seed``, ``null_rate {name: rate}``, ``constraints [...]``, ``edge_cases [...]``.
    """
    s = copy.deepcopy(spec)
    drop = set(changes.get("drop", []))
    s["columns"] = [c for c in s["columns"] if c["name"] not in drop]
    for c in s["columns"]:
        n = c["name"]
        if n in changes.get("retype", {}):
            c["type"], c["spark_type"] = changes["retype"][n]
        c["dist"].update(changes.get("params", {}).get(n, {}))
        for p, f in changes.get("scale", {}).get(n, {}).items():
            c["dist"][p] = c["dist"][p] * f
        if n in changes.get("null_rate", {}):
            c["null_rate"] = changes["null_rate"][n]
        if n in changes.get("rename", {}):
            c["name"] = changes["rename"][n]
    ren = changes.get("rename", {})
    s["corr"] = [[ren.get(a, a), ren.get(b, b), r] for a, b, r in s.get("corr", []) if a not in drop and b not in drop]
    for k in ("rows", "seed", "constraints", "edge_cases"):
        if k in changes:
            s[k] = changes[k]
    return s


def to_json(spec: dict) -> str:
    return json.dumps(spec, indent=2, sort_keys=True, default=float)
