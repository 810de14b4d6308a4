"""Registered queries over the given tables."""

from leafstack.queries import fields_match, learn_report, more, stream_jobs, text_pages  # noqa: F401
from leafstack.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
