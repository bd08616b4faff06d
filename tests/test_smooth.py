"""Additive models, scoring by subtraction and lag-wise reach against brute force."""

import itertools

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from stationweave.operators import effects, evaluation, smooth, spatial_regression

KNOTS = (0.0, 1.0, 2.5, 4.0)
HOURS = (1.0, 60.0, 110.0, 168.0)


@pytest.fixture(scope="module")
def curved(spark):
    """Stations with curves of their own, one of a single row, one with a constant covariate, one without usable rows."""
    rng = np.random.default_rng(4)
    rows = []
    for i, n in enumerate([200, 150, 120, 1, 60]):
        v = rng.uniform(0, 4, n) if i != 4 else np.full(n, 2.0)
        h = rng.integers(1, 169, n).astype(float)
        a = rng.uniform(0, 1, n)
        mu = np.exp(0.5 + 0.6 * a + 0.3 * np.sin(h / 27) + (0.2 + 0.2 * i) * np.sin(v + i))
        rows += list(zip([f"S{i}"] * n, h, v, a, rng.gamma(30, mu / 30), rng.integers(0, 5, n)))
    frame = pd.DataFrame(rows, columns=["station", "time", "v", "a", "y", "fold"])
    odd = [("S9", 5.0, 1.0, 0.5, None, 0), ("S0", 5.0, None, 0.5, 2.0, 1), ("S0", 5.0, 1.0, 0.5, -1.0, 1)]
    df = spark.createDataFrame(list(frame.itertuples(index=False, name=None)) + odd,
                               "station string, time double, v double, a double, y double, fold long").repartition(3)
    return frame, df.checkpoint()


def basis(x, knots):
    k = (np.array(knots) - knots[0]) / (knots[-1] - knots[0])
    x = (np.asarray(x) - knots[0]) / (knots[-1] - knots[0])

    def bend(i):
        cube = lambda at: np.maximum(x - at, 0) ** 3
        return (cube(k[i]) - cube(k[-1])) / (k[-1] - k[i])
    return np.column_stack([x] + [bend(i) - bend(len(k) - 2) for i in range(len(k) - 2)])


def penalty(knots):
    """The roughness by a fine sum over the second differences of the basis."""
    x = np.linspace(knots[0], knots[-1], 20001)
    b = basis(x, knots)
    second = np.diff(b, 2, axis=0) / (1 / 20000) ** 2
    matrix = second.T @ second / 20000
    return matrix / np.trace(matrix)


def dense(frame, rows=slice(None)):
    """Design matrix with a block per station, centred in the station over all rows, and the penalties of its columns."""
    own = basis(frame["v"], KNOTS)
    stations = sorted(frame["station"].unique())
    blocks = []
    for s in stations:
        here = (frame["station"] == s).to_numpy()
        block = np.zeros_like(own)
        block[here] = own[here] - own[here].mean(axis=0)
        blocks.append(block)
    x = np.column_stack([np.ones(len(frame)), frame["a"], basis(frame["time"], HOURS), *blocks])
    return x, stations


def solve(x, z, w, frame, stations, strengths):
    n, k = 2 + len(HOURS) - 1, len(KNOTS) - 1
    extra = np.zeros((x.shape[1], x.shape[1]))
    extra[2:n, 2:n] = strengths[0] * w.sum() * penalty(HOURS)
    for i, s in enumerate(stations):
        at = slice(n + i * k, n + (i + 1) * k)
        extra[at, at] = strengths[1] * w[(frame["station"] == s).to_numpy()].sum() * penalty(KNOTS)
    return np.linalg.lstsq((x * w[:, None]).T @ x + extra, (x * w[:, None]).T @ z, rcond=1e-11)[0]


SMOOTHS = [smooth.Smooth("time", HOURS), smooth.Smooth("v", KNOTS, by_station=True)]


def test_roughness_is_the_integral():
    for knots in (KNOTS, HOURS, (0.0, 1.0, 2.0)):
        assert np.allclose(smooth.roughness(knots), penalty(knots), atol=2e-3)


@pytest.mark.parametrize("link", ["log", "identity"])
def test_additive_gamma_against_the_dense_system(curved, link):
    frame, df = curved
    strengths = (0.003, 0.02)
    fit = smooth.additive_gamma(df, "y", ["a"], SMOOTHS, link=link, strengths={"time": 0.003, "v": 0.02}, tolerance=1e-8)
    assert fit.settled
    x, stations = dense(frame)
    y = frame["y"].to_numpy()
    z, w = (np.log(y), np.ones(len(y))) if link == "log" else (y, np.ones(len(y)))
    for _ in range(60):
        eta = x @ solve(x, z, w, frame, stations, strengths)
        if link == "log":
            z = eta + (y - np.exp(eta)) / np.exp(eta)
        else:
            w = 1 / np.maximum(eta, 0.1 * y.mean()) ** 2
    want = np.exp(eta) if link == "log" else eta
    got = smooth.with_fitted(df.where("y > 0 and v is not null"), fit, SMOOTHS, link=link).toPandas()
    merged = got.merge(frame.assign(want=want), on=["station", "time", "v", "a", "y"])
    assert len(merged) == len(frame) and np.allclose(merged["fitted"], merged["want"], rtol=5e-4)
    alone = smooth.with_fitted(df.where("station = 'S9' or v is null"), fit, SMOOTHS, link=link).collect()
    assert sorted((r["station"], r["fitted"] is None) for r in alone) == [("S0", True), ("S9", False)]


def test_strengths_come_from_the_folds(curved):
    frame, df = curved
    grid = (1e-5, 1e-2, 10.0)
    fit = smooth.additive_gamma(df, "y", ["a"], SMOOTHS, fold=F.col("fold"), grid=grid, iterations=1, tolerance=None)
    x, stations = dense(frame)
    z, errors = np.log(frame["y"].to_numpy()), {}
    for pair in itertools.product(grid, grid):
        errors[pair] = 0.0
        for f in range(5):
            held = (frame["fold"] == f).to_numpy()
            b = solve(x, z, (~held).astype(float), frame, stations, pair)
            errors[pair] += ((z[held] - x[held] @ b) ** 2).sum()
    best = min(errors, key=errors.get)
    assert (fit.strengths["time"], fit.strengths["v"]) == best
    assert fit.passes == 1


def test_a_straight_line_is_never_shrunk(spark):
    rng = np.random.default_rng(2)
    h = rng.uniform(1, 168, 300)
    y = np.exp(1 + 0.01 * h)
    df = spark.createDataFrame([("A", float(a), float(b)) for a, b in zip(h, y)], "station string, time double, y double")
    fit = smooth.additive_gamma(df, "y", [], [smooth.Smooth("time", HOURS)], strengths={"time": 1e6})
    assert fit.local is None
    assert fit.shared[0] == pytest.approx(1.01, abs=1e-6) and fit.shared[1] == pytest.approx(1.67, abs=1e-6)
    assert np.allclose(fit.shared[2:], 0, atol=1e-6)
    with pytest.raises(ValueError):
        smooth.additive_gamma(df.where("y < 0"), "y", [], [smooth.Smooth("time", HOURS)])


def test_masked_regressors_equal_the_decomposition_of_each_blanked_panel(panel):
    mask = evaluation.inject_gaps(panel.where(F.col("x").isNotNull()), 4, 3).checkpoint()
    # A scenario that hides all of a station, so that buckets lose their last value.
    mask = mask.unionByName(panel.where("station = 'A001'").select(F.lit(9).cast("long").alias("scenario"), "station", "ts")).checkpoint()
    columns = ["scenario", "station", "pollutant", "ts", "truth", *effects.REGRESSORS]
    blanked = evaluation.masked_panel(panel, mask, 10)
    want = effects.decomposition(blanked, group=("scenario", "pollutant")).where(F.col("truth").isNotNull()).select(*columns).toPandas()
    got = evaluation.masked_regressors(panel, mask).select(*columns).toPandas()
    order = ["scenario", "station", "ts"]
    got, want = (d.sort_values(order).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 50 and (got[order] == want[order]).all().all()
    for c in ("truth", *effects.REGRESSORS):
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-9)


def test_estimates_equal_each_method_on_the_blanked_panel(panel):
    mask = evaluation.inject_gaps(panel.where(F.col("x").isNotNull()), 2, 5).checkpoint()
    blanked = evaluation.masked_panel(panel, mask, 2)
    got = evaluation.imputation_estimates(panel, mask, 2).toPandas()
    for name, method in effects.METHODS.items():
        want = method(blanked, group=("scenario", "pollutant")).where("truth is not null").select("scenario", "truth", "x").toPandas()
        mine = got[got["method"] == name]
        assert np.allclose(np.sort(mine["estimate"].dropna()), np.sort(want["x"].dropna()), atol=1e-8)
        assert len(mine) == len(want)
    with pytest.raises(ValueError):
        evaluation.imputation_estimates(panel, mask, 2, ["sdem", "none"])


def test_pairs_of_far_stations_thin_out_with_the_hours(spark):
    reaches = spatial_regression.lag_reaches(0.2)
    assert all(a > b for a, b in zip(reaches, reaches[1:])) and reaches[0] > 100 and reaches[-1] < 1
    # Well inside of a lag's reach a weight is above zero, outside of it none is.
    for lag, reach in enumerate(reaches[:-1]):
        for d, alive in ((reach / 2, True), (reach * 1.01, False)):
            far = (np.sqrt(0.05 * d) + np.sqrt(0.95 * lag)) ** 2
            assert (np.exp(-0.5 * (far / 0.2) ** 2) > 0) == alive
    stations = spark.createDataFrame([(f"S{i}", 20.0 * i, 45.0, [1.0, 1.0], 1.0, 1) for i in range(6)],
                                     "station string, lon double, lat double, moments array<double>, dt double, time int")
    places = stations.select("station", "lon", "lat", "time")

    def met(reach):
        pairs = spatial_regression._pairs(stations, places, ["time"], ["station", "moments", "dt"], reach)
        return pairs.agg(F.sum(F.size("targets") * F.size("sources"))).first()[0]
    assert met(reaches[0]) == 36 and met(reaches[4]) < 20 and met(reaches[-1]) == 6
