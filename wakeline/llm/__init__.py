"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import audit_queries, corpus_queries, scan_queries  # noqa: F401
