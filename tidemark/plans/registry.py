"""Where queries register, each next to SQL for DuckDB where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.bindings import EVENTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The time of as-of reads over events: 2024-01-20 00:00 UTC.
AS_OF = 1_705_708_800_000_000
SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{EV}", EVENTS_SQL).replace("{AS_OF}", str(AS_OF))
        return f

    return add
