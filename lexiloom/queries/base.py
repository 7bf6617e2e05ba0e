"""Registration of queries and the SQL pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import BREAKS
from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a data folder, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL if there is any."""

    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_BREAKS_SQL = BREAKS.replace("'", "''")


def tokens_sql(column: str = "text") -> str:
    """DuckDB: the list that functions.text.tokens gives."""
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '{_BREAKS_SQL}'), lambda x: x <> '')"


def one_byte_sql(column: str) -> str:
    """DuckDB: lower-case text with the letters of Latin-1 and oe as bytes that it doesn't have, as levenshtein() compares bytes."""
    letters = "".join(map(chr, range(0xDF, 0x100))) + "œ"
    spare = " || ".join(f"chr({k})" for k in [*range(65, 91), *range(1, 9)])
    return f"translate({column}, '{letters}', {spare})"
