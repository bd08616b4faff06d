"""Gamma regressions per group and pooled, spline terms, and the forest."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import reduce

import pyspark.sql.functions as F
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import (
    GeneralizedLinearRegression, GeneralizedLinearRegressionModel, RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame

from stationweave.functions.linalg import grouped_moments, linear_predictor, solve_moments
from stationweave.operators.panel import LAGS, LEADS
from stationweave.session import ensure_checkpoint_dir


PASSES = 25


def lag_names(column: str, lags: Sequence[int] = LAGS) -> list[str]:
    return [f"{column}_lag{k}" for k in lags]


def lead_names(column: str, leads: Sequence[int] = LEADS) -> list[str]:
    return [f"{column}_lead{k}" for k in leads]


def backward_features(target: str, covariates: Sequence[str], covariate_lags: Sequence[int] = LAGS) -> list[str]:
    """Target lags, then every covariate at t and its lags."""
    out = lag_names(target)
    for c in covariates:
        out += [c, *lag_names(c, covariate_lags)]
    return out


def forward_features(target: str, covariates: Sequence[str], covariate_lags: Sequence[int] = LAGS) -> list[str]:
    """The backward features plus three leads of the target and of every covariate."""
    out = backward_features(target, covariates, covariate_lags) + lead_names(target)
    for c in covariates:
        out += lead_names(c)
    return out


def design(features: Sequence[str]) -> list[Column]:
    """Intercept and features."""
    return [F.lit(1.0), *[F.col(f) for f in features]]


def gamma_glm(
    df: DataFrame, keys: Sequence[str], target: str, features: Sequence[str], link: str = "identity",
    iterations: int = PASSES, tolerance: float | None = 1e-5,
) -> DataFrame:
    """Gamma regression of every group at once: (keys, coefficients), intercept first.

    Iteratively reweighted least squares. Each pass is one aggregation of weighted cross products, combined map-side,
    so a dominant group is summed by all tasks; only the p x p systems reach the solver. The first pass is unweighted. A
    fitted mean is not taken below a tenth of the group's mean, which bounds the weights of rows the identity link
    would send to zero or below. Stops on the relative deviance change of the slowest group; groups without a solution
    count as settled. If ``iterations`` passes don't settle every group, a warning says how many are left.
    ``tolerance=None`` makes exactly ``iterations`` passes after the first one.
    """
    if link not in ("identity", "log"):
        raise ValueError(f"unknown link: {link}")
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    y, x = F.col(target), design(features)
    usable = F.lit(True)
    for f in features:
        usable = usable & F.col(f).isNotNull()
    # A row that cannot be used keeps a NULL response, which removes it from every sum.
    rows = df.select(*keys, *features, F.when(usable & (y > 0), y).alias("_y")).persist()
    y = F.col("_y")
    try:
        current = _solved(shaped(rows, link, y), keys, x)
        for _ in range(iterations):
            known = current.select(*keys, "coefficients", F.col("deviance").alias("_before"), "_mean")
            joined = rows.join(known, keys) if keys else rows.withColumns({
                c: known.select(c).scalar() for c in ("coefficients", "_before", "_mean")})
            eta = linear_predictor(F.col("coefficients"), x)
            current = _solved(shaped(joined, link, y, eta), keys, x)
            if tolerance is None:
                continue
            change = F.abs(F.col("deviance") - F.col("_before")) / (F.abs("deviance") + 0.1)
            # A group without a solution has nothing that could still move.
            change = F.when(F.col("coefficients").isNull(), 0.0).otherwise(F.coalesce(change, F.lit(1.0)))
            moving = current.agg(F.count_if(change >= tolerance)).first()[0]
            if not moving:
                break
        else:
            if tolerance is not None:
                warnings.warn(f"{moving} groups still move after {iterations} passes", stacklevel=2)
        return current.select(*keys, "coefficients")
    finally:
        rows.unpersist()


def shaped(rows: DataFrame, link: str, y: Column, eta: Column | None = None) -> DataFrame:
    """Working response, weight and deviance contribution of every row; the first pass is plain least squares."""
    if eta is None:
        unknown = F.lit(None).cast("double")
        return rows.withColumns({"_z": y if link == "identity" else F.log(y), "_w": F.lit(1.0), "_d": unknown,
                                 "_before": unknown})
    rows = rows.withColumn("_eta", eta)
    eta = F.col("_eta")
    if link == "identity":
        rows = rows.withColumn("_mu", F.greatest(eta, 0.1 * F.col("_mean")))
        response, weight = y, 1 / (F.col("_mu") * F.col("_mu"))
    else:
        rows = rows.withColumn("_mu", F.exp(eta))
        response, weight = eta + (y - F.col("_mu")) / F.col("_mu"), F.lit(1.0)
    ratio = y / F.col("_mu")
    return rows.withColumns({"_z": response, "_w": weight, "_d": 2 * (ratio - 1 - F.log(ratio))})


def _solved(rows: DataFrame, keys: list[str], x: list[Column]) -> DataFrame:
    """Checkpointed solution per group, with the deviance of the coefficients it started from."""
    sums = grouped_moments(rows, keys, x, F.col("_z"), F.col("_w"),
                           extra={"deviance": F.sum("_d"), "_before": F.any_value("_before"), "_mean": F.avg("_y")})
    return sums.select(*keys, solve_moments("moments").alias("coefficients"), "deviance", "_before", "_mean").checkpoint()


def station_glm(panel: DataFrame, target: str, covariates: Sequence[str], keys: Sequence[str] = ("station",),
                forward: bool = False, covariate_lags: Sequence[int] = LAGS) -> DataFrame:
    """Identity-link Gamma model per station on lags, or on lags and leads."""
    names = (forward_features if forward else backward_features)(target, covariates, covariate_lags)
    return gamma_glm(panel, keys, target, names)


def _assembled(df: DataFrame, features: Sequence[str], factor: str | None) -> tuple[list, list[str]]:
    """Assembly stages and the name of every vector slot; a factor is dummy coded against its last level."""
    if factor is None:
        return [VectorAssembler(inputCols=list(features), outputCol="features")], list(features)
    index = StringIndexer(inputCol=factor, outputCol="_index", stringOrderType="alphabetAsc").fit(df)
    encode = OneHotEncoder(inputCols=["_index"], outputCols=["_dummy"]).fit(index.transform(df))
    assemble = VectorAssembler(inputCols=[*features, "_dummy"], outputCol="features")
    return [index, encode, assemble], [*features, *[f"{factor}={v}" for v in index.labels[:-1]]]


def pooled_glm(
    df: DataFrame, target: str, features: Sequence[str], link: str = "log", factor: str | None = None,
    ridge: float = 0.0,
) -> tuple[GeneralizedLinearRegressionModel, list[str]]:
    """One Gamma model over all stations, optionally with a factor such as the station type."""
    used = [target, *features, *([factor] if factor else [])]
    rows = df.select(*used).na.drop("any").where(F.col(target) > 0)
    stages, names = _assembled(rows, features, factor)
    ready = reduce(lambda d, s: s.transform(d), stages, rows).select(F.col(target).alias("label"), "features")
    fit = GeneralizedLinearRegression(family="gamma", link=link, maxIter=PASSES, tol=1e-8, regParam=ridge).fit(ready)
    if fit.hasSummary and fit.summary.numIterations >= PASSES:
        warnings.warn(f"the pooled fit still moves after {PASSES} passes", stacklevel=2)
    return fit, names


def pooled_coefficients(model: GeneralizedLinearRegressionModel) -> list[float]:
    """Intercept, then one number per feature."""
    return [float(model.intercept), *[float(c) for c in model.coefficients]]


def dummy_columns(df: DataFrame, names: Sequence[str], factor: str) -> DataFrame:
    """The model's dummy columns for a factor as plain columns."""
    made = {n: (F.col(factor) == n.split("=", 1)[1]).cast("double") for n in names if n.startswith(f"{factor}=")}
    return df.withColumns(made)


# Interior knots over the hours of the week.
WEEK_KNOTS = (1.0, 22.0, 43.0, 64.0, 85.0, 106.0, 127.0, 148.0, 168.0)


def spline_columns(df: DataFrame, column: str, knots: Sequence[float], prefix: str) -> tuple[DataFrame, list[str]]:
    """Natural cubic spline basis (linear beyond the outer knots) as built-in columns, scaled to the knot range."""
    width = knots[-1] - knots[0]
    x = (F.col(column) - knots[0]) / width
    k = [(v - knots[0]) / width for v in knots]

    def bend(i: int) -> Column:
        cube = lambda at: F.pow(F.greatest(x - at, F.lit(0.0)), 3)
        return (cube(k[i]) - cube(k[-1])) / (k[-1] - k[i])
    made = {f"{prefix}0": x}
    for i in range(len(k) - 2):
        made[f"{prefix}{i + 1}"] = bend(i) - bend(len(k) - 2)
    return df.withColumns(made), list(made)


def forest(
    df: DataFrame, target: str, features: Sequence[str], factor: str | None = None, trees: int = 100, depth: int = 8,
    seed: int = 77,
) -> tuple[RandomForestRegressionModel, list[str]]:
    """Random forest on complete rows."""
    used = [target, *features, *([factor] if factor else [])]
    rows = df.select(*used).na.drop("any")
    stages, names = _assembled(rows, features, factor)
    ready = reduce(lambda d, s: s.transform(d), stages, rows).select(F.col(target).alias("label"), "features")
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(ready), names


# Lines of a tree's text: a test, or what a leaf predicts.
_SPLIT = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


def forest_nodes(model: RandomForestRegressionModel) -> list[list[tuple]]:
    """Every tree as (feature, threshold, left, right, prediction) rows; a leaf has feature -1.

    At most trees * 2 ** (depth + 1) rows: model size, not data size. Read from the text of each tree, one call a tree.
    """
    out = []
    for tree in model.trees:
        rows: list[list] = []
        # Inner nodes whose left or right branch is still to come, innermost last.
        waiting: list[int] = []
        for line in tree.toDebugString.splitlines():
            split, leaf = _SPLIT.match(line), _LEAF.match(line)
            if not split and not leaf:
                continue
            at = len(rows)
            if waiting:
                parent = rows[waiting[-1]]
                if parent[2] < 0:
                    parent[2] = at
                else:
                    parent[3] = at
                    waiting.pop()
            if split:
                rows.append([int(split[1]), float(split[2]), -1, -1, 0.0])
                waiting.append(at)
            else:
                rows.append([-1, 0.0, -1, -1, float(leaf[1])])
        out.append([tuple(r) for r in rows])
    return out
