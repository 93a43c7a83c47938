"""Name -> (Spark plan, SQL). The SQL runs on the same parquet tables and states the result."""
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan
    return register
