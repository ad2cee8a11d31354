"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from cairn.plans.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(fx)``, where fx gives the driver tables and the fixture views, under ``name`` with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        QUERIES[name].__name__ = name
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add
