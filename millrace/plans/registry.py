"""All core queries, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "reason_counts"


def query(sql: str | None = None):
    """Register f(spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from millrace.plans import audit_queries, contract_queries, evaluation_queries, record_queries  # noqa: E402, F401
