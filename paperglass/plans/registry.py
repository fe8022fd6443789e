"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperglass.plans import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, with_roles: bool = True):
    """Registers f(roles) under its name. `sql` goes on from the roles' common table expressions, or stands alone."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(roles.Roles(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {roles.SQL} {sql}" if with_roles else sql
        return f

    return register
