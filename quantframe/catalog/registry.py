"""Query registration and the shared output contract.

A query declares its output once, as ``name:type`` pairs. Both engines cast and round to it:

``s`` string, ``d`` date, ``l`` bigint, ``b`` boolean, ``t`` timestamp rendered as text,
``f`` double at six decimals, ``m`` double at four decimals (large money sums).
NaN and infinities become null on both sides.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.catalog.fixtures import with_ctes
from quantframe.functions import clean_double, round_at
from quantframe.sources.testdata import Tables, tables_for

MODULES = (
    "scans",
    "calendars",
    "reads",
    "joins",
    "signals",
    "sizing",
    "ledger",
    "metrics",
    "validation",
    "quality",
    "futures",
    "live",
    "sets",
    "streams",
)


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None
    extra: tuple[tuple[str, str], ...] = ()

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return finish(self.build(tables_for(spark, folder)), self.columns)

    def run_fresh(self, spark: SparkSession, folder: str) -> DataFrame:
        """The same, deriving every input again (benchmarks)."""
        return finish(self.build(Tables(spark, folder)), self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        projected = ", ".join(_duck(c, t) for c, t in self.columns)
        return (
            with_ctes(self.sql, dict(self.extra))
            + f"select {projected} from (\n{self.sql}\n) result"
        )


QUERIES: dict[str, Query] = {}


def query(
    name: str, columns: str, sql: str | None = None, extra: dict[str, str] | None = None
) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    declared = tuple(tuple(part.split(":")) for part in columns.split())

    def keep(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, declared, build, sql, tuple((extra or {}).items()))
        return build

    return keep


def finish(df: DataFrame, columns: tuple[tuple[str, str], ...]) -> DataFrame:
    out = []
    for name, kind in columns:
        c = F.col(name)
        if kind == "f":
            c = round_at(clean_double(c), 6)
        elif kind == "m":
            c = round_at(clean_double(c), 4)
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        else:
            c = c.cast({"s": "string", "d": "date", "l": "bigint", "b": "boolean"}[kind])
        out.append(c.alias(name))
    return df.select(*out)


def _duck(name: str, kind: str) -> str:
    if kind in "fm":
        scale = "1e6" if kind == "f" else "1e4"
        x = f'cast("{name}" as double)'
        return (
            f"case when isfinite({x}) then floor({x} * {scale} + 0.5e0) / {scale} end as \"{name}\""
        )
    if kind == "t":
        return f"strftime(cast(\"{name}\" as timestamp), '%Y-%m-%d %H:%M:%S') as \"{name}\""
    target = {"s": "varchar", "d": "date", "l": "bigint", "b": "boolean"}[kind]
    return f'cast("{name}" as {target}) as "{name}"'


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"quantframe.catalog.{module}")
    return QUERIES
