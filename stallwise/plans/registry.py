"""The register of queries and the tables they run on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


class Tables:
    """The test tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str, read: dict[str, DataFrame] | None = None) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = dict(read or {})

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]


Plan = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    plan: Plan
    sql: str | None


REGISTER: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name, with the inventory ids it covers."""

    def add(plan: Plan) -> Plan:
        name = plan.__name__
        if name in REGISTER:
            raise ValueError(f"query {name} is registered twice")
        REGISTER[name] = Query(name, tuple(ids.split()), plan, sql)
        return plan

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def shown(df: DataFrame, *columns: str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Times as text, so both engines print them alike."""
    return df.withColumns({c: F.date_format(c, pattern) for c in columns})
