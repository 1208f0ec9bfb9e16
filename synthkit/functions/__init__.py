"""Column-expression helpers.  Everything here builds JVM-side expressions (no UDFs)."""

from synthkit.functions.random import (
    uniform, normal, normal_cdf, uuid_text, HASH_MODES,
)
from synthkit.functions.text import format_bytes, slugify, shorten, not_blank

__all__ = [
    "uniform", "normal", "normal_cdf", "uuid_text", "HASH_MODES",
    "format_bytes", "slugify", "shorten", "not_blank",
]
