"""Registration of queries with their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stationweave.plans.binding import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Exact halves in the seventh place (means of 2^k readings) would round by summation noise; this shift decides them.
HALF_SHIFT = 2e-9


def present(df: DataFrame) -> DataFrame:
    """Output form of a query: doubles to six places, whole numbers as bigint, times as text."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c + HALF_SHIFT, 6)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, oracle: str | None = None) -> Callable:
    """Register ``function(tables)``; a query without SQL is covered by the unit tests."""
    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return present(function(Tables(spark, folder)))
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register
