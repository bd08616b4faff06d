"""Planar geometry on ring arrays as Column expressions.

A zone is ``array<array<struct<x,y>>>``: closed rings, holes and parts alike. A point is inside when a ray from it
crosses an odd number of edges, so holes and multi-part zones need no special case. Edges are half open, which makes
zones that share a border tile the plane without overlap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql import types as T

from stationweave.functions.columns import EARTH_RADIUS_KM

Point = tuple[float, float]


def ring_literal(points: Sequence[Point]) -> Column:
    """One closed ring from request parameters."""
    closed = list(points) if points[0] == points[-1] else [*points, points[0]]
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in closed])


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rings of an axis-aligned rectangle."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0)))


def edges(rings: Column) -> Column:
    """All edges of all rings as array<struct<x1,y1,x2,y2>>."""
    def of_ring(ring: Column) -> Column:
        n = F.size(ring) - 1
        return F.zip_with(
            F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n),
            lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.flatten(F.transform(rings, of_ring))


def contains(edge_array: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against an edge array."""
    crossed = F.filter(edge_array, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (
        x < e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])))
    return F.size(crossed) % 2 == 1


def bounds(rings: Column) -> Column:
    """struct<x0,y0,x1,y1> of all rings."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def area_m2(rings: Column) -> Column:
    """Area on the sphere: shoelace after the equal-area map (longitude, sine of latitude)."""
    twice = F.aggregate(
        edges(rings), F.lit(0.0),
        lambda acc, e: acc + (F.radians(e["x1"]) * F.sin(F.radians(e["y2"]))
                              - F.radians(e["x2"]) * F.sin(F.radians(e["y1"]))))
    return F.abs(twice) / 2 * F.lit((EARTH_RADIUS_KM * 1000) ** 2)


def segments_cross(a: Column, b: Column) -> Column:
    """True when two edges share at least one point."""
    def side(px: Column, py: Column, e: Column) -> Column:
        return F.signum((e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"]))
    apart = ((F.greatest(a["x1"], a["x2"]) < F.least(b["x1"], b["x2"]))
             | (F.greatest(b["x1"], b["x2"]) < F.least(a["x1"], a["x2"]))
             | (F.greatest(a["y1"], a["y2"]) < F.least(b["y1"], b["y2"]))
             | (F.greatest(b["y1"], b["y2"]) < F.least(a["y1"], a["y2"])))
    return (~apart
            & (side(a["x1"], a["y1"], b) * side(a["x2"], a["y2"], b) <= 0)
            & (side(b["x1"], b["y1"], a) * side(b["x2"], b["y2"], a) <= 0))


def polygons_intersect(edges_a: Column, edges_b: Column) -> Column:
    """Two edge arrays touch, cross, or one lies inside the other."""
    touching = F.exists(edges_a, lambda a: F.exists(edges_b, lambda b: segments_cross(a, b)))
    first_a, first_b = edges_a[0], edges_b[0]
    return (touching | contains(edges_b, first_a["x1"], first_a["y1"])
            | contains(edges_a, first_b["x1"], first_b["y1"]))


def convex_hull(points: Sequence[Point]) -> list[Point]:
    """Counter-clockwise hull of the vertices of a request."""
    ordered = sorted(set((float(x), float(y)) for x, y in points))
    if len(ordered) < 3:
        raise ValueError("a hull needs at least three different points")

    def half(sequence: Sequence[Point]) -> list[Point]:
        chain: list[Point] = []
        for p in sequence:
            while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                      - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    hull = half(ordered) + half(ordered[::-1])
    if len(hull) < 3:
        raise ValueError("the points of a hull must not lie on one line")
    return hull


def in_hull(hull: Sequence[Point], x: Column, y: Column) -> Column:
    """Point inside or on a counter-clockwise convex hull, as a conjunction of half planes."""
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(hull, [*hull[1:], hull[0]], strict=True):
        inside = inside & ((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0)
    return inside


def to_wkt(rings: Column) -> Column:
    """Rings as POLYGON text."""
    def ring_text(ring: Column) -> Column:
        points = F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
        return F.concat(F.lit("("), F.array_join(points, ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, ring_text), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Rings of POLYGON or MULTIPOLYGON text; parts and holes become one ring list."""
    body = F.regexp_replace(text, r"^\s*(MULTI)?POLYGON\s*", "")
    parts = F.split(F.regexp_replace(body, r"^[(\s]+|[)\s]+$", ""), r"\)[\s)]*,[\s(]*\(")

    def ring(part: Column) -> Column:
        def point(pair: Column) -> Column:
            numbers = F.split(F.trim(pair), r"\s+")
            return F.struct(numbers[0].cast("double").alias("x"), numbers[1].cast("double").alias("y"))
        return F.transform(F.split(part, ","), point)
    return F.transform(parts, ring)


def _cross_section(edges_array: np.ndarray, x: float) -> np.ndarray:
    """Sorted heights where a vertical line meets the edges."""
    x1, y1, x2, y2 = edges_array.T
    hit = (np.minimum(x1, x2) <= x) & (x < np.maximum(x1, x2))
    return np.sort(y1[hit] + (y2[hit] - y1[hit]) * (x - x1[hit]) / (x2[hit] - x1[hit]))


def _shared_length(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap of two unions of intervals given as sorted end points."""
    low = np.maximum(a[0::2, None], b[None, 0::2])
    high = np.minimum(a[1::2, None], b[None, 1::2])
    return float(np.clip(high - low, 0.0, None).sum())


def _overlap(a: np.ndarray, b: np.ndarray, low: float = -math.inf, high: float = math.inf) -> float:
    """Area shared by two edge sets between ``low`` and ``high``: exact per vertical slab, as no edges cross inside a slab."""
    left = max(min(a[:, 0].min(), a[:, 2].min()), min(b[:, 0].min(), b[:, 2].min()), low)
    right = min(max(a[:, 0].max(), a[:, 2].max()), max(b[:, 0].max(), b[:, 2].max()), high)
    if left >= right:
        return 0.0
    da, db = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    cross = da[:, None, 0] * db[None, :, 1] - da[:, None, 1] * db[None, :, 0]
    gap = b[None, :, :2] - a[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * db[None, :, 1] - gap[..., 1] * db[None, :, 0]) / cross
        u = (gap[..., 0] * da[:, None, 1] - gap[..., 1] * da[:, None, 0]) / cross
    met = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    row = np.nonzero(met)[0]
    xs = np.concatenate([a[:, 0], b[:, 0], a[row, 0] + t[met] * da[row, 0], [left, right]])
    xs = np.unique(xs[(xs >= left) & (xs <= right)])
    total = 0.0
    for x0, x1 in zip(xs[:-1], xs[1:], strict=True):
        middle = (x0 + x1) / 2
        total += (x1 - x0) * _shared_length(_cross_section(a, middle), _cross_section(b, middle))
    return total


@F.pandas_udf(T.DoubleType())
def overlap_area(a: pd.Series, b: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """Area that two edge arrays, each flattened to [x1,y1,x2,y2,...], share between two verticals."""
    return pd.Series([_overlap(np.asarray(p, float).reshape(-1, 4), np.asarray(q, float).reshape(-1, 4), x0, x1)
                      for p, q, x0, x1 in zip(a, b, low, high, strict=True)], dtype=float)


def equal_area_edge(e: Column) -> Column:
    """An edge mapped to (longitude, sine of latitude) in radians and flattened for overlap_area."""
    return F.array(F.radians(e["x1"]), F.sin(F.radians(e["y1"])), F.radians(e["x2"]), F.sin(F.radians(e["y2"])))
