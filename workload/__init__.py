"""The workload run on the driver's tables: fixture views, queries and their SQL oracles."""

from . import (  # noqa: F401  (each registers its queries)
    activity, folds, ingest_plans, ingest_runs, landing, membership, merges, panel, quality,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
