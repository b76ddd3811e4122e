"""Registered queries: each runs one operator family over the whole given tables."""

from gridlake.queries.registry import ORACLES, QUERIES
from gridlake.queries import (  # noqa: F401
    containers,
    evaluations,
    grids,
    run_metrics,
    sampling,
    storage,
    streams,
    texts,
    transitions,
    vectors,
)

__all__ = ["ORACLES", "QUERIES"]
