"""Imports every query module, which fills the registry."""

from . import audits, cohorts, features, jobs, metric_queries, source_queries, texts  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
