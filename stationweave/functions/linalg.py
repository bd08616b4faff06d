"""Least squares from sufficient statistics: sums in Spark, tiny solves in Arrow batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def moments(features: Sequence[Column], target: Column, weight: Column) -> list[Column]:
    """Aggregates for the upper triangle of X'WX, then X'Wy, in row order."""
    scaled = [f * weight for f in features]
    p = len(features)
    sums = [F.sum(scaled[i] * features[j]) for i in range(p) for j in range(i, p)]
    return sums + [F.sum(s * target) for s in scaled]


def grouped_moments(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[Column],
    target: Column,
    weight: Column | None = None,
    name: str = "moments",
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group with the packed sums as an array; partial sums are combined before the shuffle.

    Rows with a NULL feature, target or weight do not count. They get no weight instead of being filtered out: a filter
    over many derived columns makes the optimizer's constraint inference grow exponentially.

    ``extra`` adds further aggregates by name.
    """
    complete = target.isNotNull()
    for f in features:
        complete = complete & f.isNotNull()
    df = df.withColumn("_use", F.when(complete, F.lit(1.0) if weight is None else weight))
    sums = moments(features, target, F.col("_use"))
    aliases = [f"_m{i}" for i in range(len(sums))]
    more = [c.alias(n) for n, c in (extra or {}).items()]
    return (df.groupBy(*keys).agg(*[s.alias(a) for s, a in zip(sums, aliases, strict=True)], *more)
            .select(*keys, *(extra or {}), F.array(*aliases).alias(name)))


def unpack(packed: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and right side of one packed system, or of each row of several."""
    upper = p * (p + 1) // 2
    gram = np.zeros((*packed.shape[:-1], p, p))
    i, j = np.triu_indices(p)
    gram[..., i, j] = packed[..., :upper]
    gram[..., j, i] = packed[..., :upper]
    return gram, packed[..., upper:]


def solve_packed(packed: np.ndarray) -> np.ndarray | None:
    """Coefficients of the normal equations; aliased columns get the minimum-norm solution."""
    packed = np.asarray(packed, float)
    p = int((np.sqrt(9 + 8 * len(packed)) - 3) / 2 + 0.5)
    if not np.isfinite(packed).all():
        return None
    gram, right = unpack(packed, p)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    scaled = gram / np.outer(scale, scale)
    try:
        if np.linalg.cond(scaled) < 1e12:
            return np.linalg.solve(scaled, right / scale) / scale
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(scaled, right / scale, rcond=1e-10)[0] / scale


def solve_many(packed: np.ndarray) -> list[np.ndarray | None]:
    """``solve_packed`` of every row; systems in good condition are solved together."""
    p = int((np.sqrt(9 + 8 * packed.shape[1]) - 3) / 2 + 0.5)
    good = np.isfinite(packed).all(axis=1)
    gram, right = unpack(np.where(good[:, None], packed, 0.0), p)
    own = np.diagonal(gram, axis1=1, axis2=2)
    scale = np.sqrt(np.where(own > 0, own, 1.0))
    scaled = gram / (scale[:, :, None] * scale[:, None, :])
    try:
        good &= np.linalg.cond(scaled) < 1e12
        solved = np.linalg.solve(scaled[good], (right / scale)[good][..., None])[..., 0] / scale[good]
    except np.linalg.LinAlgError:
        return [solve_packed(m) for m in packed]
    out: list[np.ndarray | None] = [None] * len(packed)
    for i, b in zip(np.flatnonzero(good), solved, strict=True):
        out[i] = b
    for i in np.flatnonzero(~good):
        out[i] = solve_packed(packed[i])
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_moments(packed: pd.Series) -> pd.Series:
    """Solve one packed system per row; NULL where the sums are missing."""
    known = packed.notna().to_numpy()
    out = pd.Series([None] * len(packed), dtype=object)
    if known.any():
        for i, b in zip(np.flatnonzero(known), solve_many(np.array(packed[known].tolist(), float)), strict=True):
            out.iat[i] = b
    return out


def linear_predictor(coefficients: Column, features: Sequence[Column]) -> Column:
    """Sum of coefficient times feature; NULL when any feature is NULL."""
    total = coefficients[0] * features[0]
    for i, f in enumerate(features[1:], start=1):
        total = total + coefficients[i] * f
    return total
