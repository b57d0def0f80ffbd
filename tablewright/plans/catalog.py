"""All registered queries; importing the modules registers them."""

from . import cleaning, estimators, evaluation, files_queries, matching_queries, profiling, values  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
