"""All registered queries (importing the modules fills the registry)."""

from synthkit.plans import catalog_profile, catalog_rows, catalog_stream, catalog_synth, catalog_validate  # noqa: F401
from synthkit.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
