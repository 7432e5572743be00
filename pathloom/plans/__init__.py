"""Registered queries; importing the package registers all of them."""

from . import queries, result_queries  # isort: skip
from . import curation_queries

__all__ = ["curation_queries", "queries", "result_queries"]
