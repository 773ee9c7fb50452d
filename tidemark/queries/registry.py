"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one directory: ``tables.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def rd(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison; sums differ in the last bits by summation order.

    The tiny shift moves values off exact decimal ties, where the last bit would decide.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double") + F.lit(10.0 ** -(digits + 3)), digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column of a result."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: rd(n, digits) for n in names}) if names else df


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL text of the same rounding (``+ 0.0`` turns -0.0 into 0.0)."""
    return f'round(CAST({expr} AS DOUBLE) + 1e-{digits + 3}, {digits}) + 0.0 AS "{name}"'


def rs(pairs: dict[str, str], digits: int = 6) -> str:
    return ",\n       ".join(r(e, n, digits) for n, e in pairs.items())
