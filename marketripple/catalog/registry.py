"""Query registry and the SQL building blocks shared by the oracle texts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketripple.plans.market import Market, market

DIGITS = 6
_QUERIES: dict[str, Callable[[Market], DataFrame]] = {}
_SQL: dict[str, str] = {}
_CTES: dict[str, str] = {}
_BODIES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    _CTES[name] = sql.strip()


def query(name: str, fn: Callable[[Market], DataFrame], sql: str | None = None, d: str = "") -> None:
    """Register a query; ``d`` names its DOUBLE columns, which both sides round to six digits."""
    assert name not in _QUERIES, name
    _QUERIES[name] = fn
    if sql is not None:
        _BODIES[name] = sql.strip()
        _SQL[name] = _assemble(sql.strip(), d.split())


def body(name: str) -> str:
    """The SQL of a registered query without its common tables, to read its rows in another query."""
    return _BODIES[name]


def _needs(sql: str) -> set[str]:
    return {w for w in re.findall(r"\b[a-z_][a-z0-9_]*\b", sql) if w in _CTES}


def _assemble(sql: str, doubles: list[str]) -> str:
    order: list[str] = []

    def visit(n: str, trail: tuple[str, ...]) -> None:
        assert n not in trail, (n, trail)
        if n in order:
            return
        for m in sorted(_needs(_CTES[n]) - {n}):
            visit(m, (*trail, n))
        order.append(n)

    for n in sorted(_needs(sql)):
        visit(n, ())
    prefix = ",\n".join(f"{n} as materialized ({_CTES[n]})" for n in order)
    body = sql
    if doubles:
        rep = ", ".join(f"round({c}, {DIGITS}) + 0.0 as {c}" for c in doubles)
        body = f"select * replace ({rep}) from ({sql}) as result_rows"
    if prefix and body.startswith("with "):
        body = f"select * from ({body}) as result_rows"
    return f"with {prefix}\n{body}" if prefix else body


def rounded(df: DataFrame) -> DataFrame:
    """Six digits on every DOUBLE column; adding 0.0 turns a negative zero into zero."""
    return df.select(*[
        (F.round(F.col(f.name), DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Callable[[Market], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: rounded(fn(market(spark, sf_dir)))
    return {n: bind(f) for n, f in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
