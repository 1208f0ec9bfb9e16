"""Latent correlations of mixed columns: numbers, dates and categories under one Gaussian copula.

Every linked column is a non-decreasing function of a latent normal: numbers and dates through their distribution,
a category through thresholds at its cumulative shares.  What is measured is Spearman's coefficient with ties, the
categories coded in an order.  With the column's mid-ranks expanded in Hermite polynomials, the coefficient that a
latent correlation rho gives is the power series of rho with the products of the two columns' coefficients; it
rises with rho, so bisection finds the rho that gives the measured one.

A category has no order of its own: it takes that of the means of the number or date that it splits best.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthkit.operators.profile import _as_double, rank_correlations

TERMS = 120
MOST = 0.999  # largest latent correlation


def _hermite(x: np.ndarray, terms: int) -> np.ndarray:
    """Normalised Hermite polynomials 0 .. terms-1 at x."""
    h = np.zeros((terms, len(x)))
    h[0] = 1.0
    if terms > 1:
        h[1] = x
    for k in range(1, terms - 1):
        h[k + 1] = (x * h[k] - math.sqrt(k) * h[k - 1]) / math.sqrt(k + 1)
    return h


def rank_series(shares: list[float] | None = None) -> np.ndarray:
    """Coefficients 1 .. TERMS of the mid-ranks, scaled to variance 1; ``shares``: of ordered categories, None: continuous."""
    k = np.sqrt(np.arange(1, TERMS + 1))
    if shares is None:
        x = np.linspace(-9, 9, 7201)
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        return math.sqrt(12) * (_hermite(x, TERMS) * density * density).sum(axis=1) * (x[1] - x[0]) / k
    p = np.array([s for s in shares if s > 0], float)
    p = p / p.sum()
    upto = np.cumsum(p)
    score = upto - p / 2
    var = float(p @ (score - 0.5) ** 2)
    if len(p) < 2 or var <= 0:
        return np.zeros(TERMS)
    cut = np.array([NormalDist().inv_cdf(float(c)) for c in upto[:-1]])
    density = np.exp(-cut * cut / 2) / math.sqrt(2 * math.pi)
    return (_hermite(cut, TERMS) * density) @ np.diff(score) / k / math.sqrt(var)


def latent(r: float, a: np.ndarray, b: np.ndarray) -> float:
    """The latent correlation under which columns of these series have rank correlation ``r``."""
    both, powers = a * b, np.arange(1, TERMS + 1)
    lo, hi = -MOST, MOST
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float((mid ** powers) @ both) < r else (lo, mid)
    return (lo + hi) / 2


def category_order(df: DataFrame, enums: list[str], numbers: list[str]) -> dict[str, list[str]]:
    """Enum column -> its values (as text) by the mean of the number that they split best (one scan)."""
    if not enums or not numbers:
        return {}
    entry = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in enums])
    x = [_as_double(df, c).alias(f"x{i}") for i, c in enumerate(numbers)]
    long = df.select(F.explode(entry).alias("e"), *x).where("e.value IS NOT NULL")
    aggs = [f(f"x{i}").alias(f"{n}{i}") for i in range(len(numbers)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
    cells: dict[str, list] = {}
    for r in long.groupBy("e.column", "e.value").agg(*aggs).collect():  # categories of the spec: bounded by enum_max
        cells.setdefault(r["column"], []).append(r)
    out = {}
    for c, rows in cells.items():
        best = (0.0, None)
        for i in range(len(numbers)):
            seen = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for r in rows if r[f"n{i}"]]
            n = sum(s[0] for s in seen)
            mean = sum(s[0] * s[1] for s in seen) / n if n else 0.0
            between, within = sum(s[0] * (s[1] - mean) ** 2 for s in seen), sum(s[0] * s[2] for s in seen)
            best = max(best, (between / (between + within) if between + within > 0 else 0.0, i), key=lambda t: t[0])
        if best[1] is not None:
            of = f"m{best[1]}"
            out[c] = [r["value"] for r in sorted(rows, key=lambda r: (r[of] is None, r[of] or 0.0, r["value"]))]
    return out


def fit_copula(df: DataFrame, columns: list[dict]) -> list[list]:
    """[a, b, latent correlation] for all pairs of the linkable columns of a spec.

    Puts the shares of the enum columns into the order that the copula uses.
    """
    numbers = [c["name"] for c in columns if c["type"] in ("int", "float", "date") and c["dist"]["family"] != "sequence"]
    enums = {c["name"]: c for c in columns if c["type"] == "enum" and c["dist"]["shares"]}
    if len(numbers) + len(enums) < 2:
        return []
    for name, values in category_order(df, list(enums), numbers).items():
        at = {v: i for i, v in enumerate(values)}
        enums[name]["dist"]["shares"].sort(key=lambda s: at.get(str(s["value"]), len(at)))
    coded = [_as_double(df, c).alias(c) for c in numbers]
    for name, c in enums.items():
        code = F.create_map(*[F.lit(x) for i, s in enumerate(c["dist"]["shares"]) for x in (str(s["value"]), float(i))])
        coded.append(F.try_element_at(code, F.col(f"`{name}`").cast("string")).alias(name))
    smooth = rank_series()
    series = {n: smooth for n in numbers} | {n: rank_series([s["share"] for s in c["dist"]["shares"]]) for n, c in enums.items()}
    found = rank_correlations(df.select(*coded), [*numbers, *enums]).collect()
    return [[r["a"], r["b"], latent(r["r"], series[r["a"]], series[r["b"]])] for r in found if r["r"] is not None and not math.isnan(r["r"])]
