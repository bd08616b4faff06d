"""Row filters, availability checks and zone selection."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from datetime import date, timedelta

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stationweave.functions.columns import positive_or_null
from stationweave.sources.readers import filter_years

__all__ = ["filter_years"]


def filter_dates(df: DataFrame, start: str, end: str, end_inclusive: bool = False) -> DataFrame:
    """begin >= start and end <= end, the end date meaning its first instant unless ``end_inclusive``."""
    stop = date.fromisoformat(end) + timedelta(days=1 if end_inclusive else 0)
    kind = df.schema["begin_ts"].dataType.typeName()
    return df.where((F.col("begin_ts") >= F.lit(start).cast(kind))
                    & (F.col("end_ts") <= F.lit(stop.isoformat()).cast(kind)))


def filter_pollutant(df: DataFrame, wanted: Sequence[str | int], vocabulary: DataFrame) -> DataFrame:
    """Rows of the wanted pollutants, given by notation or by numeric code."""
    codes = [w for w in wanted if isinstance(w, int)]
    names = [w for w in wanted if isinstance(w, str)]
    kept = vocabulary.where(F.col("notation").isin(names) | F.col("code").isin(codes))
    return df.join(kept.select(F.col("notation").alias("pollutant")).distinct(), "pollutant", "left_semi")


def notations(wanted: Sequence[str | int], vocabulary: DataFrame | None) -> list[str]:
    """Pollutant notations of a request that may name some by their numeric code, in the order of the request.

    A code that the vocabulary doesn't have is an error; what is collected is no longer than the request.
    """
    codes = sorted({w for w in wanted if isinstance(w, int)})
    if not codes:
        return list(wanted)
    if vocabulary is None:
        raise ValueError("numeric pollutant codes need the vocabulary")
    known = {r["code"]: r["notation"] for r in vocabulary.where(F.col("code").isin(codes)).groupBy("code").agg(
        F.min("notation").alias("notation")).collect()}
    if set(codes) - set(known):
        raise ValueError(f"unknown pollutant codes: {sorted(set(codes) - set(known))}")
    return list(dict.fromkeys(known[w] if isinstance(w, int) else w for w in wanted))


def missing_values(spark_df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """The wanted values that the table does not have."""
    spark = spark_df.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], f"{column} string")
    return asked.join(spark_df.select(column).distinct(), column, "left_anti")


def check_availability(df: DataFrame, column: str, wanted: Sequence[str]) -> list[str]:
    """Raise when nothing wanted exists, warn when some is missing; return what exists.

    The collected list is never longer than the request.
    """
    absent = {r[0] for r in missing_values(df, column, wanted).collect()}
    present = [w for w in wanted if w not in absent]
    if not present:
        raise ValueError(f"no requested {column} is available: {sorted(absent)}")
    if absent:
        warnings.warn(f"{column} not available: {sorted(absent)}", stacklevel=2)
    return present


def resolve_zone(zones: DataFrame, level: int, names: Sequence[str], stations: DataFrame | None = None) -> DataFrame:
    """Zone ids of the given names or ids at one level.

    At level 0 a name that no zone carries is looked up among the stations' countries. Unknown names disappear.
    """
    asked = zones.sparkSession.createDataFrame([(n,) for n in names], "asked string")
    at_level = zones.where(F.col("level") == level)
    by_name = at_level.select(F.col("zone_name").alias("asked"), "zone_id")
    by_id = at_level.select(F.col("zone_id").alias("asked"), "zone_id")
    lookup = by_name.unionByName(by_id).groupBy("asked").agg(F.min("zone_id").alias("_zone"))
    found = asked.join(lookup, "asked", "left")
    if level == 0 and stations is not None:
        countries = (stations.where(F.col("iso").isNotNull())
                     .groupBy(F.col("country").alias("asked")).agg(F.min("iso").alias("_iso")))
        found = found.join(countries, "asked", "left")
        found = found.withColumn("_zone", F.coalesce("_zone", "_iso"))
    return found.where(F.col("_zone").isNotNull()).select("asked", F.col("_zone").alias("zone_id"))


def known_zones(zone_ids: DataFrame, names: Sequence[str]) -> DataFrame:
    """Raise when none of the requested names was resolved, warn when some were not; ``zone_ids`` otherwise.

    What is collected is never longer than the request.
    """
    found = {r[0] for r in zone_ids.select("asked").distinct().collect()}
    absent = [n for n in names if n not in found]
    if len(absent) == len(names):
        raise ValueError(f"no requested zone is known: {sorted(absent)}")
    if absent:
        warnings.warn(f"zones not known: {sorted(absent)}", stacklevel=2)
    return zone_ids


def select_by_zone(stations: DataFrame, column: str, zone_ids: DataFrame) -> DataFrame:
    """Stations whose zone attribute is among the resolved ids."""
    ids = zone_ids.select(F.col("zone_id").alias(column)).distinct()
    return stations.join(ids, column, "left_semi").select(*stations.columns)


def in_filter(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    return df.join(other.select(column).distinct(), column, "left_semi").select(*df.columns)


def not_in_filter(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Complement of in_filter; a NULL is kept unless the other side has a NULL too."""
    right = other.select(F.col(column).alias("_other")).distinct()
    return df.join(right, df[column].eqNullSafe(right["_other"]), "left_anti")


def drop_all_null_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Remove groups that have no observation at all."""
    empty = df.groupBy(*keys).agg(F.count(value).alias("_n")).where(F.col("_n") == 0).select(*keys)
    return df.join(empty, list(keys), "left_anti").select(*df.columns)


def sanitize_nonpositive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: positive_or_null(c) for c in columns})


def filter_hourly(df: DataFrame) -> DataFrame:
    return df.where(F.col("averaging_time") == "hour")


def drop_incomplete_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def first_hours(df: DataFrame, hours: int, ts: str = "ts") -> DataFrame:
    """Rows earlier than the table's first hour plus ``hours``."""
    start = df.agg(F.min(ts)).scalar()
    return df.where(F.col(ts) < start + F.make_dt_interval(hours=F.lit(hours)))


def select_in_box(stations: DataFrame, corner: tuple[float, float], opposite: tuple[float, float]) -> DataFrame:
    """Stations in the rectangle spanned by two (lon, lat) corners."""
    (xa, ya), (xb, yb) = corner, opposite
    return stations.where(F.col("lon").between(min(xa, xb), max(xa, xb))
                          & F.col("lat").between(min(ya, yb), max(ya, yb)))


def any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out
