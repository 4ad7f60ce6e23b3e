"""Query definitions; importing the modules fills the registry."""

from screeline.plans import catalog_queries, cohort_queries, provenance_queries, quality, track_queries, vote_queries  # noqa: F401
from screeline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
