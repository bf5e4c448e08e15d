"""Registered queries of the library's own operators, and the same in SQL."""

from . import analytic, files, relational, selections
from .registry import QUERIES, SQL

__all__ = ["analytic", "files", "relational", "selections", "queries", "oracle_sql"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
