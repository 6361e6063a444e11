"""Named queries: a Spark function and, where SQL can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.session import apply_settings

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str  # inventory ids, separated by blanks
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")

        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            apply_settings(spark)
            return run(spark, folder)

        QUERIES[name] = Query(name, covers, prepared, sql)
        return run

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round floating columns, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
