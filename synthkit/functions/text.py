"""Small text transforms used by the row operations and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_bytes(size) -> Column:
    """``"N B"`` below 1024, else KB / MB with one decimal; MB is the largest unit.

    ``round`` first (half up) and then ``%.1f`` so ties such as 1.25 give 1.3,
    as a half-up ``toFixed(1)`` does; ``format_number`` would round half-even.
    """
    b = _col(size).cast("double")
    kb = F.format_string("%.1f KB", F.round(b / F.lit(1024.0), 1))
    mb = F.format_string("%.1f MB", F.round(b / F.lit(1048576.0), 1))
    return (F.when(b < 1024, F.concat(_col(size).cast("bigint").cast("string"), F.lit(" B")))
            .when(b < 1048576, kb).otherwise(mb))


def slugify(text, default: str = "profile") -> Column:
    """Lower-case, each run of whitespace becomes ``-``; empty result → ``default``."""
    s = F.regexp_replace(F.lower(_col(text)), r"\s+", "-")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def shorten(text, head: int = 5, tail: int = 2, mark: str = "…") -> Column:
    """``pt_8f2…a4``: keep ``head`` and ``tail`` characters when longer than both plus one."""
    s = _col(text).cast("string")
    return F.when(F.length(s) > head + tail + 1,
                  F.concat(F.substring(s, 1, head), F.lit(mark), F.right(s, F.lit(tail)))
                  ).otherwise(s)


def not_blank(text) -> Column:
    """True when the text has a non-whitespace character (trim-then-nonempty)."""
    return _col(text).rlike(r"\S")
