"""Queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

#: Modules that hold QUERIES and ORACLES.
MODULES = ("p1_references", "vector_queries", "retrieval_queries", "record_queries")


def catalogue() -> list:
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]
