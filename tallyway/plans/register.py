"""The table of queries by name, each over the driver's tables, with the same question as DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyway.plans.derive import Town
from tallyway.plans.oracle import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None, *relations: str):
    def add(f: Callable[[Town], DataFrame]) -> Callable[[Town], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Town(spark, folder))
        if text is not None:
            ORACLE_SQL[f.__name__] = sql(text, *relations)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
