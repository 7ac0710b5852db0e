"""Registry of runnable queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its checking SQL."""

    def wrap(fn: Callable[..., DataFrame]):
        from rostrum.plans.fixtures import Tables

        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            from rostrum.plans.fixtures import NL, WS

            ORACLES[name] = sql.replace("@WS@", WS).replace("@NL@", NL)
        return fn

    return wrap


def ctes(*parts: str, body: str) -> str:
    """A WITH query of named parts, each given once and in order, and a final body."""
    from rostrum.plans.fixtures import SQL

    needed: list[str] = []

    def need(name: str) -> None:
        for dep in SQL[name][0]:
            need(dep)
        if name not in needed:
            needed.append(name)

    for p in parts:
        need(p)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n][1]})" for n in needed) + "\n" + body
