"""Registered queries over the test tables, with SQL that checks them."""

import functools
import importlib

from redpen.catalog.base import Query, wide

MODULES = ["texts", "edits", "service", "reports", "corrections"]


def _modules():
    return [importlib.import_module(f"redpen.catalog.{m}") for m in MODULES]


def _widened(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark, sf_dir):
        return wide(query(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    return {name: _widened(q) for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
