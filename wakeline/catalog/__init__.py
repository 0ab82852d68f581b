"""Named queries over the given tables, each with its SQL counterpart where SQL can say it."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import aggregates, analytics, filters, jobs, joins, ordering, physics, series, sources  # noqa: F401
