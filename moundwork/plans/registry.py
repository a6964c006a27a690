"""Catalogue of runnable queries: a Spark plan, the columns it promises, and its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundwork import bindings
from moundwork.session import METHOD_LIMIT


class Tables:
    """The domain tables of one data folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        maker = bindings.MAKERS.get(name)
        if maker is None:
            raise AttributeError(name)
        frame = maker(self)
        self.__dict__[name] = frame
        return frame


# Exact decimal ties (a mean of tenths over 64 rows) would round up or down with the order of a
# sum; the shift moves the rounding edge off such values, alike in the plan and in the check SQL.
OFF_TIE = "0.000000017"


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: str
    sql: str | None
    ctes: tuple[str, ...]

    @cached_property
    def typed(self) -> list[tuple[str, str]]:
        return [tuple(item.split(":")) for item in self.columns.split()]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set(*METHOD_LIMIT)
        frame = self.build(Tables(spark, folder))
        return frame.select(*[_shape(name, kind) for name, kind in self.typed])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        ordered: list[str] = []
        for name in self.ctes:
            _visit(name, ordered)
        head = ",\n".join(f"{name} AS ({SQL_TABLES[name][0]})" for name in ordered)
        picks = ", ".join(_shape_sql(name, kind) for name, kind in self.typed)
        body = f"SELECT {picks} FROM ({self.sql}) AS result"
        return f"WITH {head}\n{body}" if head else body


CATALOG: dict[str, Entry] = {}
SQL_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {}


def sql_table(name: str, sql: str, *needs: str) -> None:
    """Name a check-SQL subquery so later queries can build on it."""
    SQL_TABLES[name] = (sql, needs)


def query(name: str, columns: str, sql: str | None = None, ctes: str = ""):
    """Register ``build(tables)`` under ``name``; ``columns`` lists name:kind pairs."""

    def register(build):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(name, build, columns, sql, tuple(ctes.split()))
        return build

    return register


def _visit(name: str, ordered: list[str]) -> None:
    if name in ordered:
        return
    for need in SQL_TABLES[name][1]:
        _visit(need, ordered)
    ordered.append(name)


def _shape(name: str, kind: str) -> Column:
    col = F.col(name)
    shaped = {
        "n": lambda: col.cast("bigint"),
        "r": lambda: F.round(col.cast("double") + float(OFF_TIE), 6) + F.lit(0.0),
        "d": lambda: F.date_format(col, "yyyy-MM-dd"),
        "t": lambda: F.date_format(col, "yyyy-MM-dd HH:mm:ss"),
        "s": lambda: col.cast("string"),
        "b": lambda: col.cast("boolean"),
    }[kind]()
    return shaped.alias(name)


def _shape_sql(name: str, kind: str) -> str:
    name = f'"{name}"'
    shaped = {
        "n": f"CAST({name} AS BIGINT)",
        "r": f"round(CAST({name} AS DOUBLE) + CAST({OFF_TIE} AS DOUBLE), 6) + CAST(0 AS DOUBLE)",
        "d": f"strftime({name}, '%Y-%m-%d')",
        "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S')",
        "s": f"CAST({name} AS VARCHAR)",
        "b": f"CAST({name} AS BOOLEAN)",
    }[kind]
    return f"{shaped} AS {name}"
