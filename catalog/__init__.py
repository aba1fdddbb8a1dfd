"""Queries over the given tables, each with the SQL that must give the same rows."""

from . import (  # noqa: F401
    parse_queries,
    request_queries,
    sample_queries,
    scan_queries,
    score_queries,
    run_queries,  # after the others: some of its SQL is made from theirs
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
