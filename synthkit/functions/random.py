"""Repeatable randomness as Column expressions.

``rand(seed)`` depends on how rows are split into partitions, so it is never
used for output.  Instead every random draw is a hash of (seed, tag, row key):
the same seed gives the same rows for any partitioning, any cluster size and
after any task retry.

Two modes:

* ``md5``  – first 52 bits of ``md5('seed:tag:key')``; reproducible outside
  Spark (DuckDB: ``('0x'||substr(md5(..),1,13))::BIGINT / 2^52``).
* ``xxhash`` – ``xxhash64`` of the same triple, 52 low bits; several times
  cheaper, Spark-only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_MODES = ("md5", "xxhash")
_TWO_52 = float(2 ** 52)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(seed: int, tag: str, key, mode: str = "md5") -> Column:
    """u in [0, 1) from (seed, tag, key); ``key`` is an integer or string Column."""
    key = _col(key)
    if mode == "md5":
        text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), key.cast("string"))
        hex13 = F.substring(F.md5(text), 1, 13)
        return F.conv(hex13, 16, 10).cast("bigint") / F.lit(_TWO_52)
    if mode == "xxhash":
        h = F.xxhash64(F.lit(int(seed)), F.lit(tag), key)
        return F.pmod(h, F.lit(2 ** 52)).cast("double") / F.lit(_TWO_52)
    raise ValueError(f"unknown hash mode {mode!r}; use one of {HASH_MODES}")


def normal(seed: int, tag: str, key, mode: str = "md5") -> Column:
    """Standard normal draw by Box-Muller on two hash uniforms."""
    u1 = uniform(seed, tag + "#1", key, mode)
    u2 = uniform(seed, tag + "#2", key, mode)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# Abramowitz & Stegun 7.1.26 coefficients for erf (|error| < 1.5e-7).
_AS_P = 0.3275911
_AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z) -> Column:
    """Phi(z) as a Column; Spark has no erf, so use the A&S rational approximation."""
    z = _col(z)
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_AS_P) * x)
    poly = F.lit(0.0)
    for a in reversed(_AS_A):
        poly = (poly + F.lit(a)) * t
    erf_abs = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.signum(z) * erf_abs)


def uuid_text(seed: int, tag: str, key, prefix: str = "") -> Column:
    """A uuid-shaped id (8-4-4-4-12 hex) from md5 of (seed, tag, key); unique per key."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), _col(key).cast("string")))
    body = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(F.lit(prefix), body) if prefix else body
