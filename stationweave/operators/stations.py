"""Station master preparation, views and attribute joins."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions.columns import (
    clean_station_name, country_to_iso, sampling_point_status,
)

STATION_KEY = ("station", "nat_code", "station_name")

# Columns of the station views, in their order.
COMPACT = (
    "country", "iso", "sampling_point_id", "station", "nat_code", "station_name", "pollutant",
    "sampling_point_status", "longitude", "latitude", "altitude", "nuts1", "nuts2", "nuts3", "lau_id", "area", "type",
)
BY_STATION = (
    "country", "iso", "station", "nat_code", "station_name", "longitude", "latitude", "altitude",
    "nuts1", "nuts1_id", "nuts2", "nuts2_id", "nuts3", "nuts3_id", "lau", "lau_id",
    "area", "type", "timezone", "sampling_point_status",
)
BY_STATION_SHORT = (
    "country", "iso", "station", "nat_code", "station_name", "longitude", "latitude", "altitude",
    "nuts1", "nuts2", "nuts3", "area", "type",
)


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def prepare_master(sampling_points: DataFrame) -> DataFrame:
    """Country code, status, clean names and one agreed coordinate per station."""
    coordinates = modal_coordinate(sampling_points)
    return (attach_modal_coordinates(sampling_points, coordinates)
            .withColumns({
                "iso": country_to_iso("country"),
                "sampling_point_status": sampling_point_status("op_end"),
                "timezone": F.upper("timezone"),
                "station_name": clean_station_name("station_name"),
            }))


def modal_coordinate(sampling_points: DataFrame) -> DataFrame:
    """Most frequent coordinate of each station; the smallest one wins a tie."""
    counted = (sampling_points.where(F.col("longitude").isNotNull())
               .groupBy(*STATION_KEY, "longitude", "latitude").agg(F.count(F.lit(1)).alias("_n")))
    best = F.min(F.struct((-F.col("_n")).alias("n"), "longitude", "latitude")).alias("_best")
    return (counted.groupBy(*STATION_KEY).agg(best)
            .select(*STATION_KEY, "_best.longitude", "_best.latitude"))


def attach_modal_coordinates(sampling_points: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Replace each sampling point's coordinate by its station's; missing key parts match each other."""
    return attach_zone_attributes(sampling_points.drop("longitude", "latitude"), coordinates)


def attach_zone_attributes(sampling_points: DataFrame, attributes: DataFrame) -> DataFrame:
    """Left join of per-station attributes on the three station keys, NULL matching NULL."""
    right = attributes.withColumnsRenamed({k: f"_{k}" for k in STATION_KEY})
    match = [sampling_points[k].eqNullSafe(right[f"_{k}"]) for k in STATION_KEY]
    return sampling_points.join(right, match, "left").drop(*[f"_{k}" for k in STATION_KEY])


def stations_by_station(master: DataFrame, complete: bool = True) -> DataFrame:
    """One row per station: its first sampling point's attributes."""
    wanted = _present(master, BY_STATION if complete else BY_STATION_SHORT)
    return first_row(master, ["station"], ["sampling_point_id"]).select(*wanted)


def stations_compact(master: DataFrame) -> DataFrame:
    return master.select(*_present(master, COMPACT))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key in the given order.

    A min over one struct combines map-side, so a key with very many rows costs one small row per task.
    """
    rest = [c for c in df.columns if c not in {*keys, *order}]
    packed = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row") if rest else F.min(
        F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)


def slice_max(df: DataFrame, keys: Sequence[str], by: str, order: Sequence[str]) -> DataFrame:
    """Row with the largest ``by`` of every key; ties go to the smallest ``order`` values."""
    rest = [c for c in df.columns if c not in set(keys)]
    rank = F.struct((-F.col(by)).alias("_by"), *order)
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
            .select(*keys, "_row.*").select(*df.columns))


def attach_station_name(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Left join of the station name; the name table is made unique first so rows never multiply."""
    names = first_row(stations.select("station", "station_name"), ["station"], ["station_name"])
    joined = df.join(names, "station", "left")
    rest = [c for c in df.columns if c != "station"]
    return joined.select("station", "station_name", *rest)


def attach_coordinates(df: DataFrame, stations: DataFrame) -> DataFrame:
    places = first_row(stations.select("station", "lon", "lat"), ["station"], ["lon", "lat"])
    return df.join(places, "station", "left")


def stations_info(stations: DataFrame, sampling_points: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """One row per (station, pollutant) for the stations at hand."""
    own = stations.select("station").distinct()
    rows = sampling_points.where(F.col("pollutant").isin(list(pollutants))).join(own, "station", "left_semi")
    return first_row(rows, ["station", "pollutant"], ["sampling_point_id"])


def attach_covariates(panel: DataFrame, stations: DataFrame, columns: Sequence[str]) -> DataFrame:
    return panel.join(stations.select("station", *columns).dropDuplicates(["station"]), "station", "left")


def merge_pollutants(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join of a second measurement table on (station, begin_ts)."""
    return left.join(right, ["station", "begin_ts"], "left")


def reorder_columns(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    middle = [c for c in df.columns if c not in {*first, *last}]
    return df.select(*first, *middle, *last)

