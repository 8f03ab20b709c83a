"""Names to queries and to their SQL."""

from __future__ import annotations

from .views import PRELUDE, Views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Views. The SQL stands behind the prelude of views."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"{PRELUDE}\n{sql.strip()}".replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return add
