"""The user-facing flows: request measurements, aggregate, summarise, interpolate, map, impute."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions.columns import level_number
from stationweave.functions import geometry
from stationweave.model import Measurements, infer_pollutants, validate_contract
from stationweave.operators import aggregate, effects, interpolate, panel, selection, stations, summary, zones

# Station attribute that names the zone of each level.
ZONE_COLUMN = {0: "iso", 1: "nuts1_id", 2: "nuts2_id", 3: "nuts3_id", 4: "lau_id"}


def get_stations(master: DataFrame, by_station: bool = False, complete: bool = True) -> DataFrame:
    if by_station:
        return stations.stations_by_station(master, complete)
    return master if complete else stations.stations_compact(master)


def get_measurements(
    measurements: DataFrame,
    master: DataFrame,
    pollutants: Sequence[str | int],
    start: int | str,
    end: int | str,
    zones_table: DataFrame | None = None,
    zone_level: str | None = None,
    zone_names: Sequence[str] | None = None,
    quadrant: Sequence[tuple[float, float]] | None = None,
    polygon: Sequence[tuple[float, float]] | None = None,
    vocabulary: DataFrame | None = None,
) -> Measurements:
    """Wide measurements of the stations in a zone, a quadrant (two corners or a hull) or a polygon, in no order.

    ``start`` and ``end`` are both years or both ISO dates. ``master`` has one row per sampling point. Pollutants are named
    by notation or, with the ``vocabulary``, by numeric code.
    """
    given = [zone_names is not None, quadrant is not None, polygon is not None]
    if sum(given) != 1:
        raise ValueError("give exactly one of zone_names, quadrant and polygon")
    if type(start) is not type(end):
        raise ValueError("start and end must both be years or both be dates")
    if validate_contract(measurements) != "long":
        raise ValueError("expected a long measurement table")
    available = selection.check_availability(master, "pollutant", selection.notations(pollutants, vocabulary))
    chosen, zone_df = master.where(F.col("pollutant").isin(available)), None
    if zone_names is not None:
        if zones_table is None or zone_level is None:
            raise ValueError("a zone request needs zones_table and zone_level")
        level = level_number(zone_level)
        ids = selection.known_zones(selection.resolve_zone(zones_table, level, zone_names, master), zone_names)
        chosen = selection.select_by_zone(chosen, ZONE_COLUMN[level], ids)
        zone_df = zones_table.where(F.col("level") == level).join(ids.select("zone_id"), "zone_id", "left_semi")
    else:
        points = chosen.withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")})
        if polygon is not None:
            points, outline = zones.select_in_polygon(points, polygon), polygon
        elif len(quadrant) == 2:
            (xa, ya), (xb, yb) = quadrant
            points, outline = selection.select_in_box(points, *quadrant), [(xa, ya), (xb, ya), (xb, yb), (xa, yb)]
        else:
            points, outline = zones.select_in_hull(points, quadrant), geometry.convex_hull(quadrant)
        chosen = points.drop("lon", "lat")
        zone_df = master.sparkSession.range(1).select(
            F.lit(None).cast("int").alias("level"), F.lit("request").alias("zone_id"),
            F.array(geometry.ring_literal(outline)).alias("rings"))
    rows = selection.in_filter(measurements, chosen, "station").where(F.col("pollutant").isin(available))
    rows = (selection.filter_years(rows, start, end) if isinstance(start, int)
            else selection.filter_dates(rows, start, end))
    wide = aggregate.pivot_measurements(rows, available)
    named = stations.attach_station_name(wide, chosen)
    return Measurements(named, tuple(available), zone_level,
                        tuple(zone_names or ()), zone_df)


def time_aggregate(
    data: Measurements, frequency: str = "monthly", functions: Sequence[str] = ("mean", "min", "max"),
) -> Measurements:
    """Long calendar aggregate of a wide measurement table, metadata kept."""
    long = aggregate.pivot_longer(data.df, data.pollutants)
    return replace(data, df=aggregate.time_aggregate(long, frequency, functions), frequency=frequency)


def prepare_master(sampling_points: DataFrame, zones_table: DataFrame) -> DataFrame:
    """The station master: codes, status, clean names, agreed coordinates and the zones of every level they lie in."""
    return zones.assign_zones(stations.prepare_master(sampling_points), zones_table)


def summarise(data: Measurements, master: DataFrame | None = None) -> dict[str, DataFrame]:
    return summary.summary(data.df, data.pollutants, master)


def idw_map_data(
    aggregated: Measurements, station_places: DataFrame, pollutant: str, statistic: str = "mean", idp: float = 2.0,
    nmax: int | None = None, maxdist: float | None = None, fill_zones: DataFrame | None = None,
    step: float | None = None,
) -> DataFrame:
    """Grid estimates inside the request's zones, or the mean per fill zone, for every date."""
    if aggregated.frequency is None or aggregated.zone_df is None:
        raise ValueError("idw_map_data needs an aggregate with its zones")
    rows = aggregated.df.where(F.col("pollutant") == pollutant).select(
        "station", "date", F.col(statistic).alias("value"))
    located = stations.attach_coordinates(rows, station_places).na.drop("any")
    ready = zones.prepare_zones(aggregated.zone_df)
    cells = interpolate.grid_mask(interpolate.make_grid(ready, step), ready)
    if fill_zones is None:
        return interpolate.idw(located, cells, idp, nmax, maxdist)
    return interpolate.idw_zonal(located, cells, fill_zones, idp=idp, nmax=nmax, maxdist=maxdist)


def impute(data: DataFrame, method: str = "sdem", pollutants: Sequence[str] | None = None) -> DataFrame:
    """Fill the hourly rows of a wide table, every pollutant at once; other rows and stations without data stay.

    Methods: sdem, sdem_global_weights, sdem_station_weights, locf.
    """
    names = list(pollutants or infer_pollutants(data))
    hourly = selection.filter_hourly(data)
    long = aggregate.pivot_longer(hourly.select("station", "begin_ts", *names), names).select(
        "station", "pollutant", F.col("begin_ts").alias("ts"), F.col("concentration").alias("x"))
    usable = selection.drop_all_null_groups(long, ["station", "pollutant"], "x")
    if method == "locf":
        filled = panel.locf(usable)
    elif method in effects.METHODS:
        filled = effects.METHODS[method](usable)
    else:
        raise ValueError(f"unknown method: {method}")
    keys = ["station", "begin_ts"]
    wide = filled.withColumnRenamed("ts", "begin_ts").groupBy(*keys).agg(
        *[F.max(F.when(F.col("pollutant") == p, F.col("x"))).alias(f"_{i}") for i, p in enumerate(names)])
    joined = hourly.join(wide, keys, "left")
    done = joined.withColumns({p: F.coalesce(p, f"_{i}") for i, p in enumerate(names)}).select(*data.columns)
    return done.unionByName(data.where(~F.col("averaging_time").eqNullSafe("hour")))
