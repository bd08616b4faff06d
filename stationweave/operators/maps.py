"""Data behind the station and interpolation maps."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions.columns import level_number
from stationweave.operators.zones import zone_children, zone_largest_overlap, zones_intersecting

# Attributes that identify a drawn point.
POINT_COLUMNS = ("country", "iso", "station", "nat_code", "station_name", "longitude", "latitude")


def station_pollutant_label(sampling_points: DataFrame, pollutants: Sequence[str],
                            keys: Sequence[str] = ("station",)) -> DataFrame:
    """Requested pollutants of each station, in request order, joined by ", "."""
    flags = [F.max(F.when(F.col("pollutant") == p, F.lit(p))).alias(f"_{i}") for i, p in enumerate(pollutants)]
    mine = sampling_points.where(F.col("pollutant").isin(list(pollutants))).groupBy(*keys).agg(*flags)
    return mine.select(*keys, F.concat_ws(", ", *[f"_{i}" for i in range(len(pollutants))]).alias("pollutants"))


def station_points(
    sampling_points: DataFrame, pollutants: Sequence[str], zone_column: str | None = None,
    zone_ids: Sequence[str] | None = None, measured: DataFrame | None = None,
) -> DataFrame:
    """One drawable row per station of the request; rows with any missing attribute are dropped."""
    rows = sampling_points
    if measured is not None:
        rows = rows.join(measured.select("station").distinct(), "station", "left_semi")
    if zone_column is not None:
        rows = rows.where(F.col(zone_column).isin(list(zone_ids or [])))
    keys = [c for c in POINT_COLUMNS if c in rows.columns]
    return station_pollutant_label(rows, pollutants, keys).na.drop("any")


def zone_bounds(
    zones: DataFrame, level: str, zone_ids: Sequence[str], inner: str | None = None,
    polygon: Sequence[tuple[float, float]] | None = None, local_zones: DataFrame | None = None,
) -> DataFrame:
    """Boundary rows to draw: role "outer" for the request, role "inner" for the finer level inside it.

    An inner level that is not finer than the request is ignored with a warning.
    """
    columns = ["zone_id", "rings"]
    if polygon is not None:
        if inner is None:
            raise ValueError("a polygon request has only inner bounds: name their level")
        pool = local_zones if inner == "LAU" else zones.where(F.col("level") == level_number(inner))
        return zones_intersecting(pool, polygon).select(F.lit("inner").alias("role"), *columns)
    at = level_number(level)
    outer = zones.where((F.col("level") == at) & F.col("zone_id").isin(list(zone_ids)))
    out = outer.select(F.lit("outer").alias("role"), *columns)
    if inner is None:
        return out
    if level_number(inner) <= at:
        warnings.warn("the inner level must be finer than the zone level; inner bounds are left out", stacklevel=2)
        return out
    if inner == "LAU":
        # The parent is chosen among all zones of the level, then restricted to the request.
        parents = zone_largest_overlap(local_zones, zones.where(F.col("level") == at))
        wanted = parents.where(F.col("parent_id").isin(list(zone_ids))).select("zone_id")
        found = local_zones.join(wanted, "zone_id", "left_semi")
    else:
        found = zone_children(zones, outer, at, level_number(inner))
    return out.unionByName(found.select(F.lit("inner").alias("role"), *columns))
