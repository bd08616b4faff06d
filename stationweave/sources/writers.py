"""Sinks. Every writer leaves as many files as the plan has partitions; nothing is gathered first."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions import geometry
from stationweave.model import validate_contract

_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    validate_contract(df)
    df.write.mode(mode).option("header", True).option("timestampFormat", _TIME_FORMAT).csv(path)


def export_txt(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Space-delimited text with a header and quoted values."""
    validate_contract(df)
    (df.write.mode(mode).option("header", True).option("sep", " ").option("quoteAll", True)
     .option("nullValue", "NA").option("timestampFormat", _TIME_FORMAT).csv(path))


def export_zone_geometry(zones: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Zone rows as Parquet: geometry as WKT, attributes with names over ten characters left out."""
    zone_geometry_table(zones).write.mode(mode).parquet(path)


def zone_geometry_table(zones: DataFrame) -> DataFrame:
    kept = [c for c in zones.columns if c != "rings" and len(c) <= 10]
    return zones.select(*kept, geometry.to_wkt(F.col("rings")).alias("wkt"))


def write_measurements(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Canonical long table: partitioned by pollutant and UTC year, sorted inside each file.

    Rows are spread by station as well, so a dominant pollutant-year is written by many tasks.
    """
    validate_contract(df)
    (df.withColumn("year", F.year("begin_ts"))
     .repartition("pollutant", "year", F.pmod(F.xxhash64("station", F.to_date("begin_ts")), F.lit(64)))
     .sortWithinPartitions("pollutant", "year", "station", "begin_ts")
     .write.mode(mode).partitionBy("pollutant", "year").parquet(path))
