"""Registered queries over the driver's tables."""

from cuecorpus.plans import frame_queries, job_queries, run_queries, text_queries  # noqa: F401
from cuecorpus.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
