"""Where queries and their checking SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.session import prepare
from docweave.sources import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in plain SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, base: str) -> DataFrame:
            return fn(prepare(spark), base)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def table_sql(name: str) -> str:
    """SQL of a derived table over the plain table names."""
    sql, needs = derived.TABLES[name]
    return sql.format(**{t: t for t in needs})


def with_tables(*names: str, texts: list[str] | None = None) -> str:
    """``WITH`` clause of derived tables; ``texts`` is their union."""
    wanted = [*names, *(t for t in (texts or []) if t not in names)]
    parts = [f"{n} AS ({table_sql(n)})" for n in wanted]
    if texts is not None:
        union = " UNION ALL ".join(f"SELECT document_id, kind, text FROM {t}" for t in texts)
        parts.append(f"texts AS ({union})")
    return "WITH " + ",\n".join(parts)


def re2(pattern: str, flags: str = "i") -> str:
    """SQL literal of a pattern for the checking engine."""
    return literal(f"(?{flags})" + pattern.replace("(?i)", ""))


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(literal(w) for w in words) + ")"


def array(words: list[str]) -> str:
    return "[" + ", ".join(literal(w) for w in words) + "]"
