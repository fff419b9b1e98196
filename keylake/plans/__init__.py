"""Queries on the given tables for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

from keylake.plans import entities, functions, parsing, relations, series, storage  # noqa: F401
from keylake.plans.registry import QUERIES, SQL


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
