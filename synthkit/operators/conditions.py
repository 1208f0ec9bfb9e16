"""Conditional inverse sampling: rare predicates on generated columns, drawn inside their own interval.

The bounds that a predicate puts on single columns (``col < number``, ``col = 'value'``, ...; joined by AND) become
intervals of the columns' uniforms, and the uniforms are drawn inside these intervals only.  Upper tails are kept
as survival probabilities, so an event of one in 10^15 keeps its precision.  An interval may hold more than the
event (rounding to integers): the whole predicate is tested on the rows afterwards, so the result is exactly the
rows' law given the predicate, and what the intervals do not express is left to rejection.

Columns linked by the copula: the rarest bounded one comes first in the Cholesky order with a truncated normal,
the others follow from it; bounds on further linked columns are left to rejection.
"""

from __future__ import annotations

import datetime
import math
import re
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from synthkit.functions.random import uniform

_PART = re.compile(r"""^\s*`?(\w+)`?\s*(>=|<=|=|>|<)\s*(?:(?:DATE\s*)?'([^']*)'|([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?))\s*$""", re.I)
_INF = math.inf
_CDF_ERROR = 2e-7  # of the uniform that a latent normal gives

# Wichura's algorithm AS 241 (PPND16), numerators and denominators from the highest power down.
_CENTRE = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
            1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
           (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077,
            687.1870074920579083, 42.313330701600911252, 1.0))
_TAIL = ((7.7454501427834140764e-4, 2.27238449892691845833e-2, 2.4178072517745061177e-1, 1.27045825245236838258, 3.64784832476320460504,
          5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
         (1.05075007164441684324e-9, 5.475938084995344946e-4, 1.51986665636164571966e-2, 1.4810397642748007459e-1,
          6.8976733498510000455e-1, 1.6763848301838038494, 2.05319162663775882187, 1.0))
_FAR = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.2426609473880784386e-3, 2.6532189526576123093e-2,
         2.9656057182850489123e-1, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
        (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
         1.48753612908506148525e-2, 1.3692988092273580531e-1, 5.9983220655588793769e-1, 1.0))


def _ratio(tables, x: Column) -> Column:
    def poly(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out
    return poly(tables[0]) / poly(tables[1])


def upper_normal(p: Column) -> Column:
    """z with P(Z > z) = p, to full precision for small p."""
    q = F.lit(0.5) - p
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    far = F.when(r <= 5, _ratio(_TAIL, r - 1.6)).otherwise(_ratio(_FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * far)


def survival(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2)) if math.isfinite(z) else (0.0 if z > 0 else 1.0)


def bounds_of(predicate: str) -> dict[str, list[tuple[str, object]]]:
    """Column -> [(operator, literal)] of the simple parts joined by AND; {} where other connectives are used."""
    plain = re.sub(r"'[^']*'", "''", predicate)
    if re.search(r"\b(or|not|case|between)\b", plain, re.I) or any(re.search(r"\band\b", q, re.I) for q in re.findall(r"'[^']*'", predicate)):
        return {}
    out: dict[str, list] = {}
    for part in re.split(r"\band\b", predicate, flags=re.I):
        if m := _PART.match(part):
            out.setdefault(m[1], []).append((m[2], m[3] if m[3] is not None else float(m[4])))
    return out


def _range(parts) -> tuple[float, float] | None:
    """Closed numeric range that holds all values meeting the parts; None: not numeric."""
    lo, hi = -_INF, _INF
    for op, v in parts:
        if not isinstance(v, float):
            return None
        lo = max(lo, v) if op in (">", ">=", "=") else lo
        hi = min(hi, v) if op in ("<", "<=", "=") else hi
    return lo, hi


def _normal_range(d: dict, lo: float, hi: float) -> tuple[float, float]:
    """The range of the column's normal."""
    if d["family"] == "gaussian":
        mu, sigma, value = d["mu"], d["sigma"], lambda x: x
    else:
        mu, sigma, value = d["mu_log"], d["sigma_log"], lambda x: math.log(x) if x > 0 else -_INF
    if not sigma:
        return -_INF, _INF
    scaled = [(value(x) - mu) / sigma if math.isfinite(x) or x < 0 else x for x in (lo, hi)]
    return (min(scaled), max(scaled)) if sigma < 0 else (scaled[0], scaled[1])


def truncated_normal(u: Column, lo: float, hi: float) -> Column:
    """Standard normal given lo <= z <= hi from a uniform in [0, 1)."""
    if lo + hi < 0:  # mirror, so that the tail in use is the upper one
        return -truncated_normal(u, -hi, -lo)
    low, high = survival(hi), survival(lo)
    p = F.least(F.lit(high) - u * F.lit(high - low), F.lit(1 - 2.0 ** -53))
    return F.least(F.greatest(upper_normal(p), F.lit(lo)), F.lit(hi))


def _chance(lo: float, hi: float) -> float:
    return survival(lo) - survival(hi) if lo + hi >= 0 else survival(-hi) - survival(-lo)


class Given:
    """How to draw the bounded columns of a spec: ``columns`` (name -> Column over id), ``linked`` (name and range of
    the truncated normal that leads the copula, or None) and ``chance``, the probability of all intervals."""

    def __init__(self, spec: dict, predicate: str):
        self.columns: dict[str, Column] = {}
        self.linked: tuple[str, float, float] | None = None
        self.chance = 1.0
        seed, mode = int(spec.get("seed", 0)), spec.get("mode", "md5")
        linked = {c for a, b, _ in spec.get("corr") or [] for c in (a, b)}
        by_name, rarest = {c["name"]: c for c in spec["columns"]}, 2.0
        for name, parts in bounds_of(predicate).items():
            if (col := by_name.get(name)) is None:
                continue
            as_int = col.get("spark_type") in ("bigint", "int", "smallint", "tinyint")
            if name in linked:
                found = _linked_range(col, parts, as_int)
                if found and (p := _chance(*found)) < rarest:
                    self.linked, rarest = (name, *found), p
                continue
            drawn = _draw(col, parts, as_int, uniform(seed, f"given:{name}", F.col("id"), mode))
            if drawn is not None:
                value, chance = drawn
                kind = col.get("spark_type")
                if as_int:
                    value = F.round(value).cast("bigint")
                elif kind and kind != "string" and col["type"] in ("enum", "date"):
                    value = value.cast(kind)
                self.columns[name] = value.alias(name)
                self.chance *= chance * (1 - float(col.get("null_rate") or 0.0))
        if self.linked:
            self.chance *= rarest


def _linked_range(col, parts, as_int):
    """The range of the latent normal that holds all values meeting the parts, or None."""
    d = col.get("dist", {})
    limits, family = _range(parts), d.get("family")
    slack = 0.5 if as_int else 0.0
    if family in ("gaussian", "lognormal") and limits is not None and col["type"] != "date":
        lo, hi = _normal_range(d, limits[0] - slack, limits[1] + slack)
        return (lo, hi) if lo <= hi else (_INF, _INF)  # no value: chance 0
    found = _uniform_range(col, d, family, parts, limits, slack)
    if found is None:
        return None
    a, b = (found[0] - _CDF_ERROR, found[1] + _CDF_ERROR)
    if found[0] > found[1] or b <= 0 or a >= 1:
        return _INF, _INF
    z = NormalDist().inv_cdf
    return (z(a) if a > 0 else -_INF), (z(b) if b < 1 else _INF)


def _uniform_range(col, d, family, parts, limits, slack):
    """The range of the column's uniform, or None."""
    if col["type"] == "enum":
        total, upto = sum(s["share"] for s in d["shares"]), 0.0
        for s in d["shares"]:
            if len(parts) == 1 and parts[0][0] == "=" and str(s["value"]) == str(parts[0][1]):
                return upto / total, (upto + s["share"]) / total
            upto += s["share"]
        return None
    if col["type"] == "date":
        if (days := _days(col, parts)) is None:
            return None
        a, b, first, last = days
        return (a - first) / (last - first + 1), (b - first + 1) / (last - first + 1)
    if limits is None:
        return None
    if family == "uniform" and d["hi"] > d["lo"]:
        n = float(d["hi"]) - float(d["lo"]) + (1 if slack else 0)
        return (max((limits[0] - d["lo"]) / n, 0.0), min((limits[1] - d["lo"] + (1 if slack else 0)) / n, 1.0))
    if family == "exponential":
        lo, hi = (max(x, 0.0) for x in (limits[0] - slack, limits[1] + slack))
        return 1 - math.exp(-d["rate"] * lo), 1 - math.exp(-d["rate"] * hi)
    return None


def _draw(col, parts, as_int, u) -> tuple[Column, float] | None:
    """(value before rounding, probability of the interval), or None: left to rejection."""
    d = col.get("dist", {})
    family = d.get("family")
    limits = _range(parts)
    slack = 0.5 if as_int else 0.0
    if col["type"] == "enum":
        if len(parts) != 1 or parts[0][0] != "=":
            return None
        total = sum(s["share"] for s in d["shares"])
        for s in d["shares"]:
            if str(s["value"]) == str(parts[0][1]):
                return F.lit(s["value"]), s["share"] / total
        return None
    if col["type"] == "date":
        return _draw_date(col, parts, u)
    if limits is None:
        return None
    lo, hi = limits[0] - slack, limits[1] + slack
    if lo > hi:
        return F.lit(None).cast("double"), 0.0
    if family in ("gaussian", "lognormal"):
        a, b = _normal_range(d, lo, hi)
        z, chance = truncated_normal(u, a, b), _chance(a, b)
        return (F.lit(float(d["mu"])) + F.lit(float(d["sigma"])) * z if family == "gaussian"
                else F.exp(F.lit(float(d["mu_log"])) + F.lit(float(d["sigma_log"])) * z)), chance
    if family == "uniform" and d["hi"] > d["lo"] or family == "uniform" and as_int:
        if as_int:  # every integer equally likely
            a, b = math.ceil(max(float(d["lo"]), limits[0])), math.floor(min(float(d["hi"]), limits[1]))
            n = d["hi"] - d["lo"] + 1
            return (F.lit(None).cast("double"), 0.0) if a > b else (F.lit(float(a)) + F.floor(u * F.lit(float(b - a + 1))), (b - a + 1) / n)
        a, b = max(float(d["lo"]), lo), min(float(d["hi"]), hi)
        return (F.lit(None).cast("double"), 0.0) if a > b else (F.lit(a) + u * F.lit(b - a), (b - a) / (d["hi"] - d["lo"]))
    if family == "exponential":
        high, low = math.exp(-d["rate"] * max(lo, 0.0)), math.exp(-d["rate"] * hi) if hi < _INF else 0.0
        if high <= low:
            return None
        return -F.log(F.lit(high) - u * F.lit(high - low)) / F.lit(float(d["rate"])), high - low
    return None


def _days(col, parts) -> tuple[int, int, int, int] | None:
    """First and last day (ordinals) that meet the parts, and those of the column."""
    d = col["dist"]
    if not (col.get("spark_type") == "date" or d.get("unit") == "day") or not all(isinstance(v, str) for _, v in parts):
        return None
    try:
        days = [(op, datetime.date.fromisoformat(v).toordinal()) for op, v in parts]
    except ValueError:
        return None
    first, last = (datetime.date.fromisoformat(d[k]).toordinal() for k in ("lo_date", "hi_date"))
    a = max([first, *(v + (op == ">") for op, v in days if op in (">", ">=", "="))])
    b = min([last, *(v - (op == "<") for op, v in days if op in ("<", "<=", "="))])
    return a, b, first, last


def _draw_date(col, parts, u):
    if (days := _days(col, parts)) is None:
        return None
    a, b, first, last = days
    if a > b:
        return F.lit(None).cast("date"), 0.0
    start = datetime.date.fromordinal(a).isoformat()
    return F.date_add(F.lit(start).cast("date"), F.floor(u * F.lit(float(b - a + 1))).cast("int")), (b - a + 1) / (last - first + 1)
