"""Queries over the driver tables, and their SQL."""


def queries() -> dict:
    from . import metrics, monitoring  # noqa: F401
    from .registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    from .registry import ORACLE_SQL

    return dict(ORACLE_SQL)
