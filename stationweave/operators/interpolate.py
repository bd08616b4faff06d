"""Prediction grids and inverse-distance interpolation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import types as T

from stationweave.functions.blocks import KM_PER_DEGREE, km_matrix, reduce_pairs, source_blocks
from stationweave.functions.columns import EARTH_RADIUS_KM
from stationweave.operators.zones import candidate_zones, point_in_zone, zonal_mean, zone_bbox_area
from stationweave.session import shuffle_width

# Area limits in m2 and their grid steps in degrees.
STEPS = ((5e8, 0.0025), (1e9, 0.005))
COARSE_STEP = 0.01
SAME_PLACE_KM = 1e-9
SIDE = 16  # lattice points per block side
TILE = 1.0  # degrees per station tile
STATION_ROWS = 256  # stations per block, on average
SLICE = 64  # dates whose values share one weight matrix, on average
TILE_SIZES = (1.0, 2.0, 4.0, 8.0, 24.0, 72.0, 360.0)  # whole tiles of TILE degrees, and whole parts of a turn

CELL = ("i", "j", "x", "y")


def grid_resolution(area_m2: Column) -> Column:
    out = F.lit(COARSE_STEP)
    for limit, step in reversed(STEPS):
        out = F.when(area_m2 < limit, F.lit(step)).otherwise(out)
    return out


def make_grid(zones: DataFrame, step: float | None = None) -> DataFrame:
    """Lattice over the whole degrees that cover the zones: i, j, x, y plus the lattice constants.

    Coordinates are origin + index * step, so they do not drift. Blocks of the lattice are spread over the cluster
    before they grow into points.
    """
    box = zone_bbox_area(zones)
    chosen = F.lit(float(step)) if step is not None else grid_resolution(F.col("area_m2"))
    frame = (box.where(F.col("x0").isNotNull())
             .select(F.floor("x0").cast("double").alias("gx0"), F.floor("y0").cast("double").alias("gy0"),
                     (F.floor("x1") + 1).cast("double").alias("_x1"), (F.floor("y1") + 1).cast("double").alias("_y1"),
                     chosen.alias("step"))
             .withColumns({"_nx": F.floor((F.col("_x1") - F.col("gx0")) / F.col("step") + 1e-6),
                           "_ny": F.floor((F.col("_y1") - F.col("gy0")) / F.col("step") + 1e-6)}))
    tiles = (frame.withColumn("bx", F.explode(F.sequence(F.lit(0), F.floor(F.col("_nx") / SIDE))))
             .withColumn("by", F.explode(F.sequence(F.lit(0), F.floor(F.col("_ny") / SIDE))))
             .repartition(shuffle_width(zones.sparkSession), "bx", "by"))

    def run(block: str, last: str) -> Column:
        start = F.col(block) * SIDE
        return F.explode(F.sequence(start, F.least(start + SIDE - 1, F.col(last))))
    return (tiles.withColumn("i", run("bx", "_nx")).withColumn("j", run("by", "_ny"))
            .select("i", "j", (F.col("gx0") + F.col("i") * F.col("step")).alias("x"),
                    (F.col("gy0") + F.col("j") * F.col("step")).alias("y"), "gx0", "gy0", "step"))


def grid_mask(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Keep the grid points inside the zones, with the id of their zone (smallest on overlap)."""
    keys = [*CELL, "gx0", "gy0", "step"]
    found = candidate_zones(cells.withColumns({"lon": F.col("x"), "lat": F.col("y")}), zones)
    return found.groupBy(*keys).agg(F.min("zone_id").alias("zone_id"))


def _target_blocks(cells: DataFrame) -> DataFrame:
    """Lattice blocks; at most SIDE * SIDE points each by construction."""
    return (cells.withColumns({"bx": F.floor(F.col("i") / SIDE), "by": F.floor(F.col("j") / SIDE)})
            .groupBy("bx", "by")
            .agg(F.collect_list(F.struct(*CELL)).alias("targets"),
                 F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                 F.max("gx0").alias("gx0"), F.max("gy0").alias("gy0"), F.max("step").alias("step")))


def _reach(sources: DataFrame, blocks: DataFrame, maxdist: float | None) -> DataFrame:
    """One row per (source block, lattice block it may serve), ready for the equi-join on the lattice block.

    Without a distance limit every lattice block is served. With one, only the blocks within the exact longitude and
    latitude reach of the source block, also where that leads over the date line.
    """
    span = blocks.agg(F.struct(
        F.min("bx").alias("bx0"), F.max("bx").alias("bx1"), F.min("by").alias("by0"), F.max("by").alias("by1"),
        F.max("gx0").alias("gx0"), F.max("gy0").alias("gy0"), F.max("step").alias("step")).alias("s")).scalar()
    rows = sources.withColumn("_s", span).where(F.col("_s.bx0").isNotNull())
    low_x, high_x = F.col("_s.bx0"), F.col("_s.bx1")
    low_y, high_y = F.col("_s.by0"), F.col("_s.by1")
    if maxdist is not None:
        degrees, wide = _degrees(F.lit(float(maxdist)), F.greatest(F.abs("lat0"), F.abs("lat1")))

        def block(value: Column, origin: str) -> Column:
            return F.floor((value - F.col(f"_s.{origin}")) / F.col("_s.step") / SIDE)
        # The reach is a longitude interval on a circle: its copies one turn to either side are cut to the lattice too.
        spans = [(F.greatest(low_x, block(F.col("lon0") - wide + turn, "gx0") - 1),
                  F.least(high_x, block(F.col("lon1") + wide + turn, "gx0") + 1)) for turn in (-360.0, 0.0, 360.0)]
        low_y = F.greatest(low_y, block(F.col("lat0") - degrees, "gy0") - 1)
        high_y = F.least(high_y, block(F.col("lat1") + degrees, "gy0") + 1)
    else:
        spans = [(low_x, high_x)]
    columns = F.array_distinct(F.concat(*[
        F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")) for low, high in spans]))
    return (rows.withColumns({"_xs": columns, "_ay": low_y, "_by": high_y})
            .where((F.size("_xs") > 0) & (F.col("_ay") <= F.col("_by")))
            .withColumn("bx", F.explode("_xs"))
            .withColumn("by", F.explode(F.sequence("_ay", "_by")))
            .drop("_s", "_xs", "_ay", "_by"))


def _gap(a0: str, a1: str, b0: str, b1: str) -> Column:
    return F.greatest(F.col(a0) - F.col(b1), F.col(b0) - F.col(a1), F.lit(0.0))


def _least_km() -> Column:
    """Lower bound of the distance between a source box and a lattice block."""
    north = _gap("lat0", "lat1", "y0", "y1") * KM_PER_DEGREE
    east = F.least(_gap("lon0", "lon1", "x0", "x1"), F.lit(90.0))
    top = F.greatest(F.abs("lat0"), F.abs("lat1"))
    across = F.asin(F.cos(F.radians(top)) * F.sin(F.radians(east))) * EARTH_RADIUS_KM
    # Longitude bounds only hold while no shorter way leads over the date line.
    wraps = (F.greatest("lon1", "x1") - F.least("lon0", "x0")) > 180
    return F.greatest(north, F.when(wraps, 0.0).otherwise(across))


def _near_blocks(named: DataFrame, blocks: DataFrame, keys: list[str], nmax: int, maxdist: float | None) -> DataFrame:
    """Source blocks that may hold one of the nmax nearest stations of a point of a lattice block: (keys, bx, by, block).

    A ring search in a pyramid of tile counts. A lattice block takes the smallest tiles whose three by three around it hold
    nmax stations; all of those are within the size of that square, so stations farther away are of no use. Only source
    blocks in the tiles within that bound are paired with it, whatever the number of stations elsewhere. Tiles go round the
    date line.
    """
    size, turns = F.col("size"), 360.0 / F.col("size")
    sizes = F.explode(F.array(*[F.lit(v) for v in TILE_SIZES]))

    def column(value: Column) -> Column:
        return F.floor((value + 180.0) / size)

    def round_trip(low: Column, high: Column) -> Column:
        """Tile columns from low to high, at most once each."""
        return F.array_distinct(F.transform(F.sequence(low, F.least(high, low + turns.cast("long") - 1)),
                                            lambda v: F.pmod(v, turns.cast("long"))))

    def row(value: Column) -> Column:
        return F.floor((value + 90.0) / size)
    placed = named.drop("sources").withColumn("size", sizes).withColumns({
        "_tx": F.pmod(column(F.col("lon0")), turns.cast("long")), "_ty": row(F.col("lat0"))})
    counts = placed.groupBy(*keys, "size", "_tx", "_ty").agg(F.sum("n_sources").alias("_n"))
    grid = blocks.drop("targets").withColumn("size", sizes)
    around = (grid.withColumn("_tx", F.explode(round_trip(column(F.col("x0")) - 1, column(F.col("x0")) + 1)))
              .withColumn("_ty", F.explode(F.sequence(row(F.col("y0")) - 1, row(F.col("y0")) + 1))))
    where = [*keys, "bx", "by"]
    sums = around.select("bx", "by", "size", "_tx", "_ty").join(counts, ["size", "_tx", "_ty"]).groupBy(*where, "size").agg(
        F.sum("_n").alias("_n"))
    # Less than nmax stations in all: the coarsest tiles, and no bound.
    ring = sums.groupBy(*where).agg(F.min(F.when(F.col("_n") >= nmax, size)).alias("_ring"))
    bound = (4 * F.col("_ring") + (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0"))) * KM_PER_DEGREE
    bound = F.coalesce(bound, F.lit(math.pi * EARTH_RADIUS_KM + 1.0))
    if maxdist is not None:
        bound = F.least(bound, F.lit(float(maxdist)))
    wanted = (ring.join(blocks.drop("targets"), ["bx", "by"])
              .withColumns({"_limit": bound, "size": F.coalesce("_ring", F.lit(TILE_SIZES[-1]))}))
    degrees, wide = _degrees(F.col("_limit"), F.greatest(F.abs("y0"), F.abs("y1")))
    tiles = (wanted.withColumn("_tx", F.explode(round_trip(column(F.col("x0") - wide), column(F.col("x1") + wide))))
             .withColumn("_ty", F.explode(F.sequence(F.greatest(row(F.col("y0") - degrees), F.lit(0)),
                                                     F.greatest(row(F.col("y1") + degrees), F.lit(0))))))
    return (tiles.join(placed, [*keys, "size", "_tx", "_ty"]).where(_least_km() <= F.col("_limit") + 1e-6)
            .select(*where, "block"))


def _degrees(km: Column, latitude: Column) -> tuple[Column, Column]:
    """How many degrees of latitude, and of longitude from up to a latitude on, a distance reaches at most."""
    tall = km / KM_PER_DEGREE + 1e-9
    ratio = F.sin(F.least(km / EARTH_RADIUS_KM, F.lit(math.pi / 2))) / F.cos(F.radians(latitude))
    wide = F.when((latitude + tall < 90) & (ratio < 1), F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)
    return tall, F.coalesce(wide, F.lit(360.0))


def _pairs(values: DataFrame, cells: DataFrame, keys: list[str], payload: Sequence[str],
           maxdist: float | None, nmax: int | None, rows: int | None = None) -> DataFrame:
    sources = source_blocks(values, keys, "station", payload, TILE, rows or STATION_ROWS)
    blocks = _target_blocks(cells)
    if nmax is None:
        return _reach(sources, blocks, maxdist).join(blocks.select("bx", "by", "targets"), ["bx", "by"])
    named = sources.withColumn("block", F.concat_ws(
        ":", F.floor(F.col("lon0") / TILE), F.floor(F.col("lat0") / TILE), F.col("part")))
    kept = _near_blocks(named, blocks, keys, nmax, maxdist)
    return (kept.join(named.select(*keys, "block", "sources"), [*keys, "block"])
            .join(blocks.select("bx", "by", "targets"), ["bx", "by"]))


_CELL_FIELDS = [T.StructField("i", T.LongType()), T.StructField("j", T.LongType()),
                T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]


def neighbours(
    stations: DataFrame, cells: DataFrame, keys: Sequence[str] = (), nmax: int | None = None,
    maxdist: float | None = None, payload: Sequence[str] = ("station",),
) -> DataFrame:
    """(keys, cell, station, km): the nmax nearest stations and/or those within maxdist km of every grid point."""
    if nmax is None and maxdist is None:
        raise ValueError("neighbours needs nmax or maxdist")
    keys = list(keys)
    values = "value" in payload

    def kernel(t: dict, s: dict) -> dict:
        order = np.argsort(s["station"])
        s = {k: v[order] for k, v in s.items()}
        km = km_matrix(t["x"], t["y"], s["lon"], s["lat"])
        ranked = np.argsort(km, axis=1, kind="stable")
        if nmax is not None:
            ranked = ranked[:, :nmax]
        row = np.repeat(np.arange(len(t["x"])), ranked.shape[1])
        col = ranked.reshape(-1)
        if maxdist is not None:
            near = km[row, col] <= maxdist
            row, col = row[near], col[near]
        out = {n: t[n][row] for n in CELL} | {"station": s["station"][col], "km": km[row, col]}
        return out | ({"value": s["value"][col]} if values else {})

    fields = [*_CELL_FIELDS, T.StructField("station", T.StringType()), T.StructField("km", T.DoubleType())]
    if values:
        fields.append(T.StructField("value", T.DoubleType()))
    pairs = _pairs(stations, cells, keys, payload, maxdist, nmax)
    found = reduce_pairs(pairs, keys, CELL, ["lon", "lat", *payload], kernel, T.StructType(fields))
    if nmax is None:
        return found
    # Every block already sent its own best nmax, so a window holds few rows per grid point.
    rank = F.row_number().over(Window.partitionBy(*keys, "i", "j").orderBy("km", "station"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nmax)


def knn_stations(stations: DataFrame, cells: DataFrame, nmax: int) -> DataFrame:
    return neighbours(stations, cells, nmax=nmax)


def stations_within_distance(stations: DataFrame, cells: DataFrame, maxdist: float) -> DataFrame:
    return neighbours(stations, cells, maxdist=maxdist)


def _weigh(rows: DataFrame, keys: list[str], idp: float) -> DataFrame:
    w = F.pow(F.greatest("km", F.lit(SAME_PLACE_KM)), F.lit(-float(idp)))
    return rows.groupBy(*keys, *CELL).agg(
        F.sum(w * F.col("value")).alias("num"), F.sum(w).alias("den"),
        F.max(F.when(F.col("km") < SAME_PLACE_KM, F.col("value"))).alias("exact"))


def idw(
    values: DataFrame, cells: DataFrame, idp: float = 2.0, nmax: int | None = None, maxdist: float | None = None,
    keys: Sequence[str] = ("date",),
) -> DataFrame:
    """Inverse-distance estimate per (keys, grid point) for all dates in one plan.

    ``values`` holds keys, station, lon, lat, value (NULL values are left out). A station exactly at a grid point gives
    its own value; a point without any station in reach is NULL. Mask the grid first: only masked points are computed.
    """
    keys = list(keys)
    rows = values.where(F.col("value").isNotNull()).select(*keys, "station", "lon", "lat", "value")
    if nmax is not None:
        parts = _weigh(neighbours(rows, cells, keys, nmax, maxdist, ("station", "value")), keys, idp)
    else:
        parts = _partial_sums(rows, cells, keys, idp, maxdist)
    found = parts.select(*keys, *CELL, F.coalesce(
        F.col("exact"), F.try_divide("num", "den")).alias("value"))
    if maxdist is None:
        return found
    # Points out of every station's reach still appear, with NULL, for each date that has data.
    frame = _frame(rows, cells, keys)
    return frame.join(found.select(*keys, "i", "j", "value"), [*keys, "i", "j"], "left")


def _frame(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return cells.select(*CELL)
    dates = rows.select(*keys).distinct().agg(F.collect_list(F.struct(*keys))).scalar()
    return cells.select(*CELL, F.explode(dates).alias("_k")).select("_k.*", *CELL)


def _partial_sums(rows: DataFrame, cells: DataFrame, keys: list[str], idp: float, maxdist: float | None) -> DataFrame:
    """Weighted sums per (keys, grid point).

    Dates are cut into slices, and a station block holds a slice's values. Distances and weights are made once per
    (station block, grid block, slice) and meet the slice's values, stations x dates, in two matrix products.
    """
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    dated = rows.select(key.alias("_k"), *keys).distinct()
    slices = F.ceil(F.lit(1.0) * dated.agg(F.count(F.lit(1))).scalar() / SLICE).cast("long")
    sliced = rows.withColumns({"_k": key, "_p": F.xxhash64("station", "lon", "lat")}).withColumn(
        "_slice", F.pmod(F.xxhash64("_k"), F.greatest(slices, F.lit(1))))

    def kernel(t: dict, s: dict) -> dict:
        dates, k = np.unique(s["_k"], return_inverse=True)
        _, first, p = np.unique(s["_p"], return_index=True, return_inverse=True)
        shape = (len(first), len(dates))
        total, count, top = np.zeros(shape), np.zeros(shape), np.full(shape, -np.inf)
        np.add.at(total, (p, k), s["value"])
        np.add.at(count, (p, k), 1.0)
        np.maximum.at(top, (p, k), s["value"])
        km = km_matrix(t["x"], t["y"], s["lon"][first], s["lat"][first])
        w = np.maximum(km, SAME_PLACE_KM) ** -float(idp)
        if maxdist is not None:
            w = np.where(km <= maxdist, w, 0.0)
        same = np.full((len(t["x"]), len(dates)), -np.inf)
        for point, station in np.argwhere(km < SAME_PLACE_KM):
            same[point] = np.maximum(same[point], top[station])
        out = {n: np.repeat(t[n], len(dates)) for n in CELL} | {"_k": np.tile(dates, len(t["x"]))}
        return out | {"num": (w @ total).ravel(), "den": (w @ count).ravel(), "same": same.ravel()}

    fields = T.StructType([*_CELL_FIELDS, T.StructField("_k", T.LongType()),
                           *[T.StructField(n, T.DoubleType()) for n in ("num", "den", "same")]])
    pairs = _pairs(sliced, cells, ["_slice"], ["_k", "_p", "value"], maxdist, None, STATION_ROWS * SLICE)
    made = reduce_pairs(pairs, ["_slice"], CELL, ["lon", "lat", "_k", "_p", "value"], kernel, fields)
    sums = made.groupBy("_k", *CELL).agg(
        F.sum("num").alias("num"), F.nullif(F.sum("den"), F.lit(0.0)).alias("den"),
        F.max(F.when(F.col("same") > F.lit(float("-inf")), F.col("same"))).alias("exact"))
    return sums.join(dated, "_k") if keys else sums


def idw_zonal(values: DataFrame, cells: DataFrame, zones: DataFrame, **options) -> DataFrame:
    """Mean of the grid estimates per (date, zone); zones may be finer than those that masked the grid."""
    keys = list(options.get("keys", ("date",)))
    estimates = idw(values, cells, **options).withColumns({"lon": F.col("x"), "lat": F.col("y")})
    inside = point_in_zone(estimates, zones, ["i", "j"])
    return zonal_mean(inside.where(F.col("zone_id").isNotNull()), keys)


def value_domain(df: DataFrame, value: str, from_zero: bool = False) -> DataFrame:
    """Legend range of a statistic over all dates."""
    low = F.lit(0.0) if from_zero else F.min(value)
    return df.agg(low.alias("low"), F.max(value).alias("high"))
