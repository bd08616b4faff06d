"""Zone geometry: assignment, hierarchy, intersection, overlap."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stationweave.functions import geometry
from stationweave.operators.stations import slice_max

CELL_DEGREES = 1.0
# Degrees added to a cell's sides where edges are dealt to it, for rounding.
EDGE_SLACK = 1e-9
# Edges of one zone that a slab should hold at most where a column is cut into slabs.
SLAB_EDGES = 256


def prepare_zones(zones: DataFrame) -> DataFrame:
    """Add the edge array and the bounding box used by the spatial predicates."""
    return (zones.withColumn("edges", geometry.edges(F.col("rings")))
            .withColumn("box", geometry.bounds(F.col("rings"))))


def _covering(zones: DataFrame, cell: float) -> DataFrame:
    """One row per (zone, grid cell its box touches)."""
    def span(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    return (zones.withColumn("_cx", span("box.x0", "box.x1"))
            .withColumn("_cy", span("box.y0", "box.y1")))


def candidate_zones(points: DataFrame, zones: DataFrame, cell: float = CELL_DEGREES) -> DataFrame:
    """(point, zone) rows where the point lies in the zone: cell equi-join, box test, then the ray test.

    A cell gets only the edges that an eastward ray from one of its points can cross; a cell without any is outside.
    """
    keyed = points.withColumns({"_cx": F.floor(F.col("lon") / cell), "_cy": F.floor(F.col("lat") / cell)})
    ready = zones if "edges" in zones.columns else prepare_zones(zones)
    west, south = F.col("_cx") * cell - EDGE_SLACK, F.col("_cy") * cell - EDGE_SLACK
    north = (F.col("_cy") + 1) * cell + EDGE_SLACK
    crossable = F.filter("edges", lambda e: (F.greatest(e["x1"], e["x2"]) >= west) & (
        F.greatest(e["y1"], e["y2"]) >= south) & (F.least(e["y1"], e["y2"]) <= north))
    covering = (_covering(ready.select("zone_id", "edges", "box"), cell).withColumn("edges", crossable)
                .where(F.size("edges") > 0))
    near = keyed.join(covering, ["_cx", "_cy"])
    x, y = F.col("lon"), F.col("lat")
    in_box = x.between(F.col("box.x0"), F.col("box.x1")) & y.between(F.col("box.y0"), F.col("box.y1"))
    return (near.where(in_box).where(geometry.contains(F.col("edges"), x, y))
            .drop("_cx", "_cy", "edges", "box"))


def point_in_zone(
    points: DataFrame, zones: DataFrame, key: Sequence[str], name: str = "zone_id", cell: float = CELL_DEGREES,
) -> DataFrame:
    """Zone of every point as a new column; the smallest id when zones overlap, NULL outside all zones."""
    places = points.select(*key, "lon", "lat").distinct()
    found = candidate_zones(places, zones, cell).groupBy(*key, "lon", "lat").agg(F.min("zone_id").alias(name))
    return points.join(found, [*key, "lon", "lat"], "left").select(*points.columns, name)


# The level of each pair of zone columns in the master.
ZONE_LEVELS = ((1, "nuts1"), (2, "nuts2"), (3, "nuts3"), (4, "lau"))


def assign_zones(sampling_points: DataFrame, zones_table: DataFrame) -> DataFrame:
    """Add name and id of the zone of every level that the station's coordinate lies in: nuts1, nuts1_id, ..., lau, lau_id.

    Each distinct station place is tested once for all levels; the smallest id wins where zones of a level overlap. A
    station without a coordinate, or outside of all zones of a level, has none; existing columns of these names go.
    """
    made = [c for _, n in ZONE_LEVELS for c in (n, f"{n}_id")]
    base = sampling_points.drop(*[c for c in made if c in sampling_points.columns])
    places = base.select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).where(
        F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).distinct()
    # A level is part of the zone's id here, so that one pass over cells and edges serves all levels.
    tagged = zones_table.where(F.col("level").isin([level for level, _ in ZONE_LEVELS])).withColumn(
        "zone_id", F.concat_ws(":", F.col("level").cast("string"), "zone_id"))
    found = candidate_zones(places, tagged).select("lon", "lat", F.substring_index("zone_id", ":", 1).cast("int").alias("_level"),
                                                   F.expr("substring(zone_id, instr(zone_id, ':') + 1)").alias("_id"))
    best = found.groupBy("lon", "lat").agg(*[
        F.min(F.when(F.col("_level") == level, F.col("_id"))).alias(f"{name}_id") for level, name in ZONE_LEVELS])
    for level, name in ZONE_LEVELS:
        titles = zones_table.where(F.col("level") == level).groupBy(F.col("zone_id").alias(f"{name}_id")).agg(
            F.min("zone_name").alias(name))
        best = best.join(titles, f"{name}_id", "left")
    match = (base["longitude"] == best["lon"]) & (base["latitude"] == best["lat"])
    return base.join(best, match, "left").select(*base.columns, *made)


def select_in_polygon(points: DataFrame, polygon: Sequence[geometry.Point]) -> DataFrame:
    """Points inside one polygon given as request parameters."""
    edge_array = geometry.edges(F.array(geometry.ring_literal(polygon)))
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    box = F.col("lon").between(min(xs), max(xs)) & F.col("lat").between(min(ys), max(ys))
    return points.where(box).where(geometry.contains(edge_array, F.col("lon"), F.col("lat")))


def select_in_hull(points: DataFrame, vertices: Sequence[geometry.Point]) -> DataFrame:
    """Points in the convex hull of three or more request points, border included."""
    hull = geometry.convex_hull(vertices)
    xs, ys = [p[0] for p in hull], [p[1] for p in hull]
    box = F.col("lon").between(min(xs), max(xs)) & F.col("lat").between(min(ys), max(ys))
    return points.where(box).where(geometry.in_hull(hull, F.col("lon"), F.col("lat")))


def zone_children(zones: DataFrame, parents: DataFrame, parent_level: int, level: int) -> DataFrame:
    """Zones of a finer level whose id starts with one of the parent ids."""
    ids = parents.where(F.col("level") == parent_level).select(F.col("zone_id").alias("_prefix")).distinct()
    finer = zones.where(F.col("level") == level)
    return finer.join(ids, F.substring("zone_id", 1, parent_level + 2) == F.col("_prefix"), "left_semi")


def zones_intersecting(zones: DataFrame, polygon: Sequence[geometry.Point]) -> DataFrame:
    """Zones that share at least one point with a request polygon."""
    other = geometry.edges(F.array(geometry.ring_literal(polygon)))
    ready = zones if "edges" in zones.columns else prepare_zones(zones)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    near = ((F.col("box.x0") <= max(xs)) & (F.col("box.x1") >= min(xs))
            & (F.col("box.y0") <= max(ys)) & (F.col("box.y1") >= min(ys)))
    return (ready.where(near).where(geometry.polygons_intersect(F.col("edges"), other))
            .select(*[c for c in zones.columns]))


def _column_edges(zones: DataFrame, name: str, cell: float) -> DataFrame:
    """One row per edge and grid column that it touches. Vertical edges bound no area and are left out."""
    edge = F.explode(geometry.edges(F.col("rings"))).alias("_e")
    low, high = F.least("_e.x1", "_e.x2"), F.greatest("_e.x1", "_e.x2")
    return (zones.select(F.col("zone_id").alias(name), edge).where(F.col("_e.x1") != F.col("_e.x2"))
            .withColumn("_cx", F.explode(F.sequence(F.floor((low - EDGE_SLACK) / cell), F.floor((high + EDGE_SLACK) / cell)))))


def _slab_edges(rows: DataFrame, grid: DataFrame, name: str, cell: float) -> DataFrame:
    """Edges by zone and slab: (name, _cx, _k, edges as one flat array)."""
    offset = F.col("_cx") * cell
    width = F.lit(cell) / F.col("_slabs")

    def slab(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_slabs") - 1, F.floor((x - offset) / width)))
    low, high = F.least("_e.x1", "_e.x2") - EDGE_SLACK, F.greatest("_e.x1", "_e.x2") + EDGE_SLACK
    dealt = rows.join(grid, "_cx").withColumn("_k", F.explode(F.sequence(slab(low), slab(high))))
    return (dealt.groupBy(name, "_cx", "_slabs", "_k")
            .agg(F.flatten(F.collect_list(geometry.equal_area_edge(F.col("_e")))).alias(f"_{name}")))


def zone_largest_overlap(
    fine: DataFrame, coarse: DataFrame, cell: float = CELL_DEGREES, slab_edges: int = SLAB_EDGES,
) -> DataFrame:
    """For every fine zone the coarse zone sharing the largest area with it (km2); smallest id on a tie.

    Grid columns are cut into vertical slabs, the more the more edges of one zone a column holds, and edges are dealt to
    slabs. Zones whose boxes meet are compared slab by slab and the areas summed, so no outline is ever whole in one row;
    only edges that run through the same slab are. Areas that agree to a square metre tie.
    """
    def boxes(zones: DataFrame, name: str) -> DataFrame:
        return _covering(zones.select(F.col("zone_id").alias(name), geometry.bounds(F.col("rings")).alias("box")), cell)
    left, right = boxes(fine, "zone_id").withColumnRenamed("box", "_box"), boxes(coarse, "parent_id")
    overlap = ((F.col("_box.x0") <= F.col("box.x1")) & (F.col("box.x0") <= F.col("_box.x1"))
               & (F.col("_box.y0") <= F.col("box.y1")) & (F.col("box.y0") <= F.col("_box.y1")))
    # A pair meets in every shared cell; keep the one cell holding the corner of the common box.
    home = ((F.col("_cx") == F.floor(F.greatest("_box.x0", "box.x0") / cell))
            & (F.col("_cy") == F.floor(F.greatest("_box.y0", "box.y0") / cell)))
    pairs = left.join(right, ["_cx", "_cy"]).where(overlap & home).select("zone_id", "parent_id")

    ours, theirs = _column_edges(fine, "zone_id", cell), _column_edges(coarse, "parent_id", cell)
    sizes = [e.groupBy(n, "_cx").agg(F.count(F.lit(1)).alias("_n")).select("_cx", "_n")
             for e, n in ((ours, "zone_id"), (theirs, "parent_id"))]
    # One row per column of the globe.
    grid = sizes[0].unionByName(sizes[1]).groupBy("_cx").agg(F.ceil(F.max("_n") / slab_edges).alias("_slabs"))
    met = (pairs.join(_slab_edges(ours, grid, "zone_id", cell), "zone_id")
           .join(_slab_edges(theirs, grid, "parent_id", cell), ["parent_id", "_cx", "_slabs", "_k"]))

    def border(k: Column) -> Column:
        """The same expression for the end of a slab and the start of the next."""
        return F.radians(F.col("_cx") * cell + k * cell / F.col("_slabs"))
    end = F.when(F.col("_k") + 1 == F.col("_slabs"), F.radians((F.col("_cx") + 1) * cell)).otherwise(border(F.col("_k") + 1))
    shared = met.select("zone_id", "parent_id", (geometry.overlap_area("_zone_id", "_parent_id", border(F.col("_k")), end)
                                                 * F.lit(geometry.EARTH_RADIUS_KM ** 2)).alias("_km2"))
    # Decimals add up to the same sum in any order.
    total = F.sum(F.col("_km2").cast("decimal(26,15)")).cast("double")
    areas = shared.where(F.col("_km2") > 0).groupBy("zone_id", "parent_id").agg(total.alias("area_km2"))
    ranked = areas.where(F.col("area_km2") > 0).withColumn("_area", F.round("area_km2", 6))
    return slice_max(ranked, ["zone_id"], "_area", ["parent_id"]).drop("_area")


def country_name_lookup(zones: DataFrame) -> DataFrame:
    """Add the name of the level-0 zone of the same country."""
    countries = zones.where(F.col("level") == 0).select("country_code", F.col("zone_name").alias("country_name"))
    return zones.join(countries.dropDuplicates(["country_code"]), "country_code", "left")


def zone_bbox_area(zones: DataFrame) -> DataFrame:
    """One row: the common box and the total area (m2) of the zones."""
    ready = zones if "box" in zones.columns else prepare_zones(zones)
    return ready.agg(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"),
                     F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"),
                     F.sum(geometry.area_m2(F.col("rings"))).alias("area_m2"))


def zonal_mean(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return cells.groupBy(*keys, "zone_id").agg(F.avg(value).alias(value))


def attach_zone_values(zones: DataFrame, values: DataFrame) -> DataFrame:
    """Zone rows with their values; zones without a value keep NULL."""
    return zones.join(values, "zone_id", "left")
