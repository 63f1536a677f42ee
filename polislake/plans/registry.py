"""Registry of named queries: a Spark builder and, where possible, its SQL check."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from polislake.plans.bindings import BASE_TABLES, VIEWS, Tables
from polislake.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name`` with an optional DuckDB check."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def oracle(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every civic view it names."""
    order: list[str] = []

    def visit(view: str) -> None:
        if view in order:
            return
        for dep in re.findall(r"\{(\w+)\}", VIEWS[view]):
            if dep in VIEWS:
                visit(dep)
        order.append(view)

    for view in _needs(sql):
        visit(view)
    names = {n: n for n in (*BASE_TABLES, *VIEWS)}
    ctes = [f"{v} AS ({VIEWS[v].format(**names)})" for v in order]
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?is)with\s", body):
        keyword = "WITH RECURSIVE " if re.match(r"(?is)with\s+recursive\s", body) else "WITH "
        rest = re.sub(r"(?is)^with(\s+recursive)?\s", "", body, count=1)
        return keyword + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body


def spark_callable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.build(Tables(configure(spark), sf_dir))

    run.__name__ = q.name
    return run
