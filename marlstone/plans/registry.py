"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.vectors import rounded


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, floats: tuple[str, ...] = ()) -> Callable:
        """Registers a function of (spark, sf_dir) under its name.

        ``floats`` are rounded to nine places in the query and in its SQL: sums in another order differ in their last bits.
        """

        def wrap(f: Callable) -> Callable:
            def made(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(spark, sf_dir).withColumns({c: rounded(F.col(c), 9) for c in floats})

            self.queries[f.__name__] = made if floats else f
            if sql:
                same = ", ".join(f'round("{c}", 9) AS "{c}"' for c in floats)
                self.oracles[f.__name__] = f"SELECT * REPLACE ({same}) FROM ({sql}) AS plain" if floats else sql
            return f

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
