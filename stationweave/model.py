"""Schemas and the measurement container."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The long measurement contract.
LONG_SCHEMA = T.StructType([
    T.StructField("station", T.StringType()),
    T.StructField("pollutant", T.StringType()),
    T.StructField("concentration", T.DoubleType()),
    T.StructField("averaging_time", T.StringType()),
    T.StructField("begin_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
])

# Columns of the wide table that are not pollutants.
WIDE_FIXED = ("station", "station_name", "averaging_time", "begin_ts", "end_ts")
# Columns of an aggregate table that are not statistics.
AGGREGATE_FIXED = ("station", "station_name", "pollutant", "date")

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))

FREQUENCIES = ("yearly", "monthly", "weekly", "daily", "hourly")


@dataclass(frozen=True)
class Measurements:
    """A measurement table with the request it came from. Nothing here is driver-collected data."""

    df: DataFrame
    pollutants: tuple[str, ...]
    zone_level: str | None = None
    zone_names: tuple[str, ...] = field(default=())
    zone_df: DataFrame | None = None
    frequency: str | None = None


def infer_pollutants(df: DataFrame, fixed: Sequence[str] = WIDE_FIXED) -> list[str]:
    """Pollutants of a wide table: the columns outside the fixed contract, in table order."""
    return [name for name in df.columns if name not in set(fixed)]


def is_measurement_table(df: DataFrame) -> bool:
    """True for a long or a wide measurement table."""
    try:
        validate_contract(df)
    except ValueError:
        return False
    return True


def validate_contract(df: DataFrame) -> str:
    """Return "long" or "wide"; raise ValueError when the table is neither. Runs no job."""
    types = {f.name: f.dataType for f in df.schema.fields}
    times = (T.TimestampType, T.TimestampNTZType)
    if not {"station", "begin_ts"} <= types.keys():
        raise ValueError("a measurement table needs the columns station and begin_ts")
    if not isinstance(types["begin_ts"], times):
        raise ValueError("begin_ts must be a timestamp")
    if {"pollutant", "concentration"} <= types.keys():
        if not isinstance(types["concentration"], T.DoubleType):
            raise ValueError("concentration must be a double")
        return "long"
    pollutants = infer_pollutants(df)
    if not pollutants:
        raise ValueError("no pollutant column found")
    wrong = [p for p in pollutants if not isinstance(types[p], T.NumericType)]
    if wrong:
        raise ValueError(f"pollutant columns must be numeric: {wrong}")
    return "wide"
