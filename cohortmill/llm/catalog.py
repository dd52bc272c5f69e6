"""Imports every query module of the subpackage, which fills the registry."""

from . import join_queries, layout_queries, score_queries, screen_queries, structure_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
