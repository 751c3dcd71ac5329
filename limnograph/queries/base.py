"""Registration of named queries with their reference SQL.

A query lists its output columns once; both sides are cast from that list. A column is
``name`` (text), ``name:i`` (bigint), ``name:d`` (double, six digits), ``name:f`` (the same for results of
long sums: a nudge of 1e-9 rounds halves the same way on both sides), ``name:t`` (date as text) or ``name:b`` (boolean).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from limnograph.queries.sql import VIEWS
from limnograph.sources.monitoring_view import MonitoringView

Build = Callable[[MonitoringView], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Build
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(MonitoringView(spark, folder.rstrip("/")))
        return df.selectExpr(*[_spark_column(name, kind) for name, kind in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        columns = ", ".join(_sql_column(name, kind) for name, kind in self.columns)
        return f"WITH {VIEWS} SELECT {columns} FROM ({self.sql}) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
    parsed = tuple(tuple((c + ":s").split(":")[:2]) for c in columns.split())

    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, parsed, build, sql)
        return build

    return register


def _spark_column(name: str, kind: str) -> str:
    c = f"`{name}`"
    if kind in "df":
        value = f"CAST({c} AS DOUBLE)"
        return f"round({value if kind == 'd' else f'{value} + 1e-9'}, 6) + 0D AS {c}"
    kind = {"i": "BIGINT", "b": "BOOLEAN"}.get(kind, "STRING")
    return f"CAST({c} AS {kind}) AS {c}"


def _sql_column(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind in "df":
        value = f"CAST({c} AS DOUBLE)"
        return f"round({value if kind == 'd' else f'{value} + 1e-9'}, 6) + 0.0 AS {c}"
    kind = {"i": "BIGINT", "b": "BOOLEAN"}.get(kind, "VARCHAR")
    return f"CAST({c} AS {kind}) AS {c}"
