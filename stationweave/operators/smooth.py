"""Additive Gamma models with penalised smooths, pooled or one per station.

The model is intercept + features + smooths of columns over all stations + smooths of columns by station. Its normal
equations have an arrow shape: the coefficients of a station's own smooth meet those that all stations share, but never
those of another station. So one aggregation of cross products per station and pass is enough, however many stations there
are: each station's block is eliminated where its sums are, what remains of the shared block is summed over stations, the
driver solves that small system, and every station gets its own coefficients back from it.

A smooth is a natural cubic spline and its penalty the integral of its squared second derivative, which acts on the bends
only: a straight line is never shrunk. The strengths of the penalties are chosen by cross-validated error, which follows
from the cross products of the folds, so choosing them reads no data again.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from stationweave.functions.linalg import grouped_moments, linear_predictor, unpack
from stationweave.operators.regression import PASSES, WEEK_KNOTS, shaped, spline_columns
from stationweave.session import ensure_checkpoint_dir

# Strengths that cross-validation tries for every smooth, as shares of the sum of weights.
STRENGTHS = (1e-6, 1e-4, 1e-2, 1.0, 100.0)
FOLDS = 5


@dataclass(frozen=True)
class Smooth:
    """A smooth of ``column`` with the given knots, over all rows or one ``by_station``."""

    column: str
    knots: tuple[float, ...] = WEEK_KNOTS
    by_station: bool = False

    @property
    def name(self) -> str:
        return f"smooth_{self.column}_"


@dataclass
class AdditiveFit:
    """Shared coefficients (intercept first), the stations' own ones, strengths by column, and how the passes ended.

    ``local`` has the keys, ``own`` (coefficients of the smooths by station, in their order) and ``center`` (the means of
    their basis columns in the station, which are taken off); it is None without such smooths.
    """

    names: list[str]
    shared: list[float]
    local_names: list[str]
    local: DataFrame | None
    strengths: dict[str, float]
    passes: int
    settled: bool


def roughness(knots: Sequence[float]) -> np.ndarray:
    """Integral over the knot range, scaled to 1, of products of second derivatives of ``spline_columns``' basis.

    Second derivatives are straight between knots, so Simpson's rule is exact there. Scaled to a trace of 1.
    """
    at = (np.asarray(knots, float) - knots[0]) / (knots[-1] - knots[0])

    def bend(i: int, x: np.ndarray) -> np.ndarray:
        return 6 * (np.maximum(x - at[i], 0) - np.maximum(x - at[-1], 0)) / (at[-1] - at[i])
    low, high = at[:-1], at[1:]
    points = np.concatenate([low, (low + high) / 2, high])
    weights = np.concatenate([high - low, 4 * (high - low), high - low]) / 6
    last = len(at) - 2
    second = np.array([np.zeros(len(points))] + [bend(i, points) - bend(last, points) for i in range(last)])
    matrix = (second * weights) @ second.T
    return matrix / np.trace(matrix) if last else matrix


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a symmetric system; what the data leave open gets the smallest solution."""
    scale = np.sqrt(np.where(np.diag(matrix) > 0, np.diag(matrix), 1.0))
    scaled, rhs = matrix / np.outer(scale, scale), (right.T / scale).T
    if len(scale) and np.linalg.cond(scaled) < 1e12:
        found = np.linalg.solve(scaled, rhs)
    else:
        found = np.linalg.lstsq(scaled, rhs, rcond=1e-10)[0]
    return (found.T / scale).T


@dataclass(frozen=True)
class _Shape:
    """Where the blocks lie: ``p`` shared columns, then the local ones; penalties as (first column, matrix)."""

    p: int
    q: int
    pooled: tuple[tuple[int, np.ndarray], ...]
    local: tuple[tuple[int, np.ndarray], ...]

    def system(self, packed: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross products with the local columns centred: taking off a mean is a change of columns."""
        gram, right = unpack(packed, self.q)
        change = np.eye(self.q)
        change[0, self.p:] = -center
        return change.T @ gram @ change, change.T @ right

    def penalised(self, gram: np.ndarray, strengths: Sequence[float], blocks: Sequence[tuple[int, np.ndarray]],
                  weight: float) -> np.ndarray:
        out = gram.copy()
        for strength, (first, matrix) in zip(strengths, blocks, strict=True):
            n = len(matrix)
            out[first:first + n, first:first + n] += strength * weight * matrix
        return out

    def eliminated(self, gram: np.ndarray, right: np.ndarray, strengths: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local response to (right, shared columns), and the shared block without the local one."""
        p = self.p
        own = self.penalised(gram, strengths, self.local, gram[0, 0])[p:, p:]
        response = _solve(own, np.column_stack([right[p:], gram[p:, :p]]))
        return response, gram[:p, :p] - gram[:p, p:] @ response[:, 1:], right[:p] - gram[:p, p:] @ response[:, 0]


def _pack(gram: np.ndarray, right: np.ndarray, weight: float) -> np.ndarray:
    return np.concatenate([gram[np.triu_indices(len(right))], right, [weight]])


def _parts(row) -> list[np.ndarray]:
    return [np.asarray(x, float) for x in row]


def _shared_sums(stations: DataFrame, shape: _Shape, choices: list[tuple[tuple, int | None]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For every (local strengths, fold left out) the shared system summed over stations.

    What reaches the driver is as long as the choices times the shared block, whatever the number of stations.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def reduced(parts: pd.Series, center: pd.Series) -> pd.Series:
        out = []
        for folds, c in zip(parts, center, strict=True):
            folds, c, made = _parts(folds), np.asarray(c, float), []
            for strengths, left in choices:
                packed = sum(f for i, f in enumerate(folds) if i != left)
                if isinstance(packed, int) or packed[0] <= 0:
                    made.append(np.zeros(shape.p * (shape.p + 1) // 2 + shape.p + 1))
                    continue
                gram, right = shape.system(packed, c)
                weight = gram[0, 0]
                _, gram, right = shape.eliminated(gram, right, strengths)
                made.append(_pack(gram, right, weight))
            out.append(np.concatenate(made))
        return pd.Series(out)

    entries = stations.select(F.posexplode(reduced("_parts", "_center")).alias("at", "v"))
    sums = {r["at"]: r["v"] for r in entries.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    size = shape.p * (shape.p + 1) // 2 + shape.p + 1
    out = []
    for k in range(len(choices)):
        packed = np.array([sums.get(k * size + i, 0.0) for i in range(size)])
        gram, right = unpack(packed[:-1], shape.p)
        out.append((gram, right, float(packed[-1])))
    return out


def _chosen(stations: DataFrame, shape: _Shape, folds: int, grid: Sequence[float]) -> tuple[tuple, tuple]:
    """Pooled and local strengths with the smallest error on the folds that were left out; ties go to the stronger."""
    local = list(product(grid, repeat=len(shape.local)))
    pooled = list(product(grid, repeat=len(shape.pooled)))
    choices = [(s, f) for s in local for f in range(folds)]
    tried, betas = [], []
    for (strengths, left), (gram, right, weight) in zip(choices, _shared_sums(stations, shape, choices), strict=True):
        for s in pooled:
            tried.append((s, strengths, left))
            betas.append(_solve(shape.penalised(gram, s, shape.pooled, weight), right))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def errors(parts: pd.Series, squares: pd.Series, center: pd.Series) -> pd.Series:
        out = []
        for folded, zz, c in zip(parts, squares, center, strict=True):
            folded, c = _parts(folded), np.asarray(c, float)
            held = [shape.system(f, c) for f in folded]
            made, known = [], {}
            for (_, strengths, left), beta in zip(tried, betas, strict=True):
                gram, right = held[left]
                if gram[0, 0] <= 0:
                    made.append(0.0)
                    continue
                if (strengths, left) not in known:
                    rest = sum(f for i, f in enumerate(folded) if i != left)
                    if rest[0] > 0:
                        response = shape.eliminated(*shape.system(rest, c), strengths)[0]
                    else:
                        response = np.zeros((shape.q - shape.p, shape.p + 1))
                    known[strengths, left] = response
                response = known[strengths, left]
                b = np.concatenate([beta, response[:, 0] - response[:, 1:] @ beta])
                made.append(zz[left] - 2 * b @ right + b @ gram @ b)
            out.append(np.array(made))
        return pd.Series(out)

    entries = stations.select(F.posexplode(errors("_parts", "_squares", "_center")).alias("at", "v"))
    sums = {r["at"]: r["v"] for r in entries.groupBy("at").agg(F.sum("v").alias("v")).collect()}
    total: dict[tuple, float] = {}
    for at, (s, strengths, _) in enumerate(tried):
        total[s, strengths] = total.get((s, strengths), 0.0) + sums.get(at, 0.0)
    least = min(total.values())
    return max(k for k, v in total.items() if v <= least * (1 + 1e-12))


def additive_gamma(
    df: DataFrame, target: str, features: Sequence[str], smooths: Sequence[Smooth], keys: Sequence[str] = ("station",),
    link: str = "log", strengths: Mapping[str, float] | None = None, fold: Column | None = None, folds: int = FOLDS,
    grid: Sequence[float] = STRENGTHS, iterations: int = PASSES, tolerance: float | None = 1e-5,
) -> AdditiveFit:
    """Penalised Gamma regression with pooled and station-wise smooths.

    Iteratively reweighted least squares with one aggregation per pass. ``strengths`` (by column) fixes the penalties; without
    it they are chosen on the first pass from ``folds`` folds, dealt by ``fold`` or by a hash of the row, and then stay.
    ``tolerance=None`` makes exactly ``iterations`` passes after the first one, which is unweighted least squares on the
    link's scale. Rows without a positive target or with a missing feature do not count. A station without rows has no
    coefficients of its own. The basis columns of a smooth by station are centred in the station.
    """
    if link not in ("identity", "log"):
        raise ValueError(f"unknown link: {link}")
    ensure_checkpoint_dir(df.sparkSession)
    keys, pooled, local = list(keys), [s for s in smooths if not s.by_station], [s for s in smooths if s.by_station]
    group = keys if local else []
    names, local_names, shapes = list(features), [], {False: [], True: []}
    rows = df
    for s in [*pooled, *local]:
        rows, basis = spline_columns(rows, s.column, s.knots, s.name)
        into = local_names if s.by_station else names
        shapes[s.by_station].append((len(into) + (0 if s.by_station else 1), roughness(s.knots)))
        into += basis
    p, q = len(names) + 1, len(names) + 1 + len(local_names)
    shape = _Shape(p, q, tuple(shapes[False]), tuple((p + first, m) for first, m in shapes[True]))
    usable = F.col(target) > 0
    for c in [*names, *local_names]:
        usable = usable & F.col(c).isNotNull()
    part = fold if fold is not None else F.pmod(F.xxhash64(*group, target, *names, *local_names), F.lit(folds))
    rows = rows.select(*group, *names, *local_names, F.when(usable, F.col(target)).alias("_y"),
                       F.pmod(part, F.lit(folds)).cast("int").alias("_fold")).persist()
    x = [F.lit(1.0), *[F.col(c) for c in names], *[F.col(c) for c in local_names]]
    y = F.col("_y")
    try:
        mean = rows.agg(F.avg("_y")).first()[0]
        if mean is None:
            raise ValueError("no row can be used")
        first = shaped(rows, link, y)
        sums = grouped_moments(first, [*group, "_fold"], x, F.col("_z"), F.col("_w"),
                               extra={"_zz": F.sum(F.col("_use") * F.col("_z") * F.col("_z"))})
        stations = _folded(sums, group, folds, p, q).checkpoint()
        if strengths is None:
            chosen = _chosen(stations, shape, folds, grid)
        else:
            chosen = tuple(tuple(float(strengths[s.column]) for s in kind) for kind in (pooled, local))
        known = {s.column: v for s, v in zip([*pooled, *local], [*chosen[0], *chosen[1]], strict=True)}
        beta, own = _solved(stations, shape, chosen, group)
        center = stations.select(*group, "_center")
        before, passes, settled = None, 0, False
        while passes < iterations and not settled:
            passes += 1
            eta = linear_predictor(F.array(*[F.lit(float(b)) for b in beta]), x[:p])
            placed = rows.withColumn("_mean", F.lit(float(mean)))
            if local:
                placed = placed.join(own, group, "left")
                for i, c in enumerate(local_names):
                    eta = eta + F.coalesce(F.col("own")[i] * (F.col(c) - F.col("center")[i]), F.lit(0.0))
            sums = grouped_moments(shaped(placed, link, y, eta), group, x, F.col("_z"), F.col("_w"), extra={"_d": F.sum("_d")})
            sums = sums.checkpoint()
            deviance = sums.agg(F.sum("_d")).first()[0]
            again = (sums.join(center, group) if group else sums.withColumn("_center", F.array().cast("array<double>"))).select(
                *group, F.array("moments").alias("_parts"), "_center").where(F.col("moments")[0].isNotNull())
            beta, own = _solved(again, shape, chosen, group)
            if tolerance is not None and before is not None:
                settled = abs(deviance - before) / (abs(deviance) + 0.1) < tolerance
            before = deviance
        if tolerance is not None and not settled:
            warnings.warn(f"the additive fit still moves after {passes} passes", stacklevel=2)
        return AdditiveFit(names, [float(b) for b in beta], local_names, own if local else None, known, passes, settled)
    finally:
        rows.unpersist()


def _folded(sums: DataFrame, group: list[str], folds: int, p: int, q: int) -> DataFrame:
    """One row per station: the packed sums and squares of every fold, and the means of the local columns.

    A station has ``folds`` rows at most, so its lists are as long as that.
    """
    empty = F.array_repeat(F.lit(0.0), q * (q + 1) // 2 + q)
    entry = F.struct(F.col("_fold"), F.col("moments"), F.col("_zz"))
    listed = sums.where(F.col("moments")[0].isNotNull()).groupBy(*group).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("_fold"), entry))).alias("_all"))
    each = [F.try_element_at("_all", F.lit(i)) for i in range(folds)]
    parts = F.array(*[F.coalesce(e["moments"], empty) for e in each])
    total = [sum((F.coalesce(e["moments"][j], F.lit(0.0)) for e in each), F.lit(0.0)) for j in (0, *range(p, q))]
    return listed.where(F.size("_all") > 0).select(
        *group, parts.alias("_parts"), F.array(*[F.coalesce(e["_zz"], F.lit(0.0)) for e in each]).alias("_squares"),
        F.array(*[t / total[0] for t in total[1:]]).cast("array<double>").alias("_center"))


def _solved(stations: DataFrame, shape: _Shape, chosen: tuple[tuple, tuple], group: list[str]) -> tuple[np.ndarray, DataFrame | None]:
    """Shared coefficients, and the stations' own ones as a checkpointed table."""
    ((gram, right, weight),) = _shared_sums(stations, shape, [(chosen[1], None)])
    beta = _solve(shape.penalised(gram, chosen[0], shape.pooled, weight), right)
    if not group:
        return beta, None

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def back(parts: pd.Series, center: pd.Series) -> pd.Series:
        out = []
        for folds, c in zip(parts, center, strict=True):
            gram, right = shape.system(sum(_parts(folds)), np.asarray(c, float))
            response = shape.eliminated(gram, right, chosen[1])[0]
            out.append(response[:, 0] - response[:, 1:] @ beta)
        return pd.Series(out)

    return beta, stations.select(*group, back("_parts", "_center").alias("own"), F.col("_center").alias("center")).checkpoint()


def with_fitted(df: DataFrame, fit: AdditiveFit, smooths: Sequence[Smooth], keys: Sequence[str] = ("station",), link: str = "log",
                name: str = "fitted") -> DataFrame:
    """Add the fitted mean; NULL where a feature is missing. A station without own coefficients gets the shared part alone."""
    rows = df
    for s in smooths:
        rows, _ = spline_columns(rows, s.column, s.knots, s.name)
    eta = linear_predictor(F.array(*[F.lit(b) for b in fit.shared]), [F.lit(1.0), *[F.col(f"`{n}`") for n in fit.names]])
    if fit.local is not None:
        rows = rows.join(fit.local, list(keys), "left")
        for i, c in enumerate(fit.local_names):
            own = F.when(F.col("own").isNull(), 0.0).otherwise(F.col("own")[i] * (F.col(c) - F.col("center")[i]))
            eta = eta + own
    return rows.withColumn(name, F.exp(eta) if link == "log" else eta).select(*df.columns, name)
