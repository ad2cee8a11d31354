"""Queries over the driver tables, one per operator, with their DuckDB counterparts."""

from cairn.plans import graph, history, insight, retrieval, risk, text  # noqa: F401
from cairn.plans.registry import ORACLES, QUERIES  # noqa: F401
