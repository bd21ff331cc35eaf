"""Registry of named queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS = {"rank", "claim", "pos", "grp", "index", "selection_rank"}


class Tables:
    """The given tables of one folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its SQL twin.

    Ranks and positions are widened to bigint, the type SQL databases give them.
    """

    def run(fn: Callable[[Tables], DataFrame], spark: SparkSession, folder: str) -> DataFrame:
        out = fn(Tables(spark, folder))
        ranks = {c: F.col(c).cast("bigint") for c, t in out.dtypes if t == "int" and c in RANKS}
        return out.withColumns(ranks) if ranks else out

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(fn, spark, folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
