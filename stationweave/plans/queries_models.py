"""Queries over the regression, forest, local-regression and refitting operators."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions.columns import time_of_week
from stationweave.operators import (
    aggregate, effects, evaluation, panel, recursion, regression, rolling, smooth, spatial_regression, stations,
)
from stationweave.plans.binding import COVARIATE, SECOND_COVARIATE, TARGET, Tables
from stationweave.plans.oracle_views import r, sql, stamp
from stationweave.plans.queries_analytics import CALENDAR, LOCF_SQL, SCENARIOS, SEED, moment_sql, renamed, solve_views
from stationweave.plans.registry import query
from stationweave.session import ensure_checkpoint_dir

NAMES = [TARGET, COVARIATE, SECOND_COVARIATE]
BANDWIDTH = 0.3


def complete_panel(t: Tables) -> DataFrame:
    """station, lon, lat, type, ts and three pollutants without a gap: decomposition, then carry-forward.

    Written once: every model below reads it several times.
    """
    ensure_checkpoint_dir(t.spark)
    done = panel.locf(effects.sdem(t.panel.where(F.col("pollutant").isin(NAMES))).checkpoint())
    wide = done.groupBy("station", "ts").agg(
        *[F.max(F.when(F.col("pollutant") == p, F.col("x"))).alias(p) for p in NAMES])
    return stations.attach_covariates(wide, t.panel_place, ["lon", "lat", "type"]).checkpoint()


def model_panel(t: Tables) -> DataFrame:
    """The complete panel with drawn gaps in the target."""
    whole = complete_panel(t)
    mask = evaluation.inject_gaps(t.panel_obs, 1, SEED).drop("scenario").withColumn("_hit", F.lit(True)).checkpoint()
    holed = whole.join(mask, ["station", "ts"], "left")
    return holed.withColumn(TARGET, F.when(F.col("_hit").isNull(), F.col(TARGET))).drop("_hit")


def warmed_panel(t: Tables) -> DataFrame:
    """The model panel with its first hours filled."""
    return effects.warm_up(model_panel(t), 6, TARGET, "ts", ()).checkpoint()


def terms(coefficients: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """Coefficient arrays as (keys, term, coefficient) rows."""
    labels = F.array(*[F.lit(n) for n in ("intercept", *names)])
    pairs = F.arrays_zip(labels.alias("term"), F.col("coefficients").alias("coefficient"))
    return coefficients.select(*keys, F.explode(pairs).alias("_t")).select(*keys, "_t.term", "_t.coefficient")


@query("glm_gamma_station")
def _(t: Tables) -> DataFrame:
    rows = panel.panel_features(warmed_panel(t), TARGET, [COVARIATE])
    fitted = regression.station_glm(rows, TARGET, [COVARIATE])
    return terms(fitted, regression.backward_features(TARGET, [COVARIATE]), "station")


@query("glm_gamma_station_fwd")
def _(t: Tables) -> DataFrame:
    rows = panel.panel_features(warmed_panel(t), TARGET, [COVARIATE])
    fitted = regression.station_glm(rows, TARGET, [COVARIATE], forward=True)
    return terms(fitted, regression.forward_features(TARGET, [COVARIATE]), "station")


def _pooled_rows(t: Tables) -> DataFrame:
    return panel.panel_features(warmed_panel(t), TARGET, [COVARIATE, SECOND_COVARIATE], lags=panel.LONG_LAGS)


POOLED = [*regression.lag_names(TARGET, panel.LONG_LAGS), COVARIATE, SECOND_COVARIATE]


def _model_terms(t: Tables, link: str, model, names: list[str]) -> DataFrame:
    rows = list(zip([link] * (len(names) + 1), ["intercept", *names], regression.pooled_coefficients(model), strict=True))
    return t.spark.createDataFrame(rows, "link string, term string, coefficient double")


@query("glm_gamma_pooled")
def _(t: Tables) -> DataFrame:
    rows = _pooled_rows(t)
    made = [_model_terms(t, link, *regression.pooled_glm(rows, TARGET, POOLED, link, "type")) for link in ("log", "identity")]
    return made[0].unionByName(made[1])


@query("gam_smooth_time")
def _(t: Tables) -> DataFrame:
    """The smooth of the hour of the week beside lags, covariates and the station type; strength by cross-validation over days."""
    rows = _pooled_rows(t)
    # One row per station type.
    types = sorted(x["type"] for x in rows.select("type").distinct().collect() if x["type"] is not None)[:-1]
    names = [f"type={v}" for v in types]
    rows = regression.dummy_columns(rows, names, "type")
    smooths = [smooth.Smooth("time")]
    fit = smooth.additive_gamma(rows, TARGET, [*POOLED, *names], smooths, fold=F.xxhash64(F.to_date("ts")))
    return smooth.with_fitted(rows, fit, smooths).select("station", "ts", "fitted")


@query("rf_impute")
def _(t: Tables) -> DataFrame:
    rows = panel.panel_features(effects.warm_up(model_panel(t), 24 * 14, TARGET, "ts", ()), TARGET,
                                [COVARIATE, SECOND_COVARIATE], lags=panel.LONG_LAGS)
    rows = rows.withColumn("traffic", (F.col("type") == "traffic").cast("double"))
    names = ["time", *regression.lag_names(TARGET, panel.LONG_LAGS), COVARIATE, SECOND_COVARIATE, "traffic"]
    positions = {k: i + 1 for i, k in enumerate(panel.LONG_LAGS)}
    return recursion.forest_fill(rows, TARGET, names, positions).select("station", "ts", TARGET)


LOCAL = ["click_lag1", "click_lag2", "view"]
LOCAL_VIEWS = {
    "carried": f"select station, pollutant, ts, {LOCF_SQL} as x from panel",
    "wd": "select station, ts, max(case when pollutant = 'click' then x end) as y, max(case when pollutant = 'view' then x end) as v "
          "from carried group by 1, 2",
    "ft": "select *, lag(y, 1) over (partition by station order by ts) as l1, lag(y, 2) over (partition by station order by ts) "
          "as l2 from wd",
    "pl": "select station, 5e0 + ((n * 37) % 100) / 100e0 as lon, 40e0 + ((n * 53) % 100) / 100e0 as lat from "
          "(select distinct station, cast(substr(station, 2, 4) as int) as n from panel_obs) q",
    "st": f"select station, sum(y * y) as yy, {moment_sql(['1e0', 'l1', 'l2', 'v'], 'y')} from ft "
          "where l1 is not null and l2 is not null group by 1",
}
_SUMS = ", ".join([f"sum(w * a{i}{j}) as a{i}{j}" for i in range(4) for j in range(i, 4)] + [f"sum(w * b{i}) as b{i}" for i in range(4)])
_SQUARED = "(pow(t.lon - u.lon, 2) + pow(t.lat - u.lat, 2))"
GWR_VIEWS = LOCAL_VIEWS | {
    "s0": f"select station, {_SUMS} from (select t.station, exp(-0.5e0 * {_SQUARED} / pow({BANDWIDTH}e0, 2)) as w, st.* exclude "
          "(station) from pl t cross join st join pl u on u.station = st.station) q group by 1",
} | solve_views("station", 4)


def local_rows(t: Tables) -> DataFrame:
    """Located target rows with two lags and a covariate, gaps carried forward."""
    done = panel.locf(t.panel.where(F.col("pollutant").isin(TARGET, COVARIATE)))
    wide = done.groupBy("station", "ts").agg(
        *[F.max(F.when(F.col("pollutant") == p, F.col("x"))).alias(p) for p in (TARGET, COVARIATE)])
    return panel.add_lags(stations.attach_covariates(wide, t.panel_place, ["lon", "lat"]), TARGET, ["station"], lags=(1, 2))


@query("gwr", sql(" union all ".join(
    f"select station, '{name}' as term, {r(f'c{i}')} as coefficient from k0"
    for i, name in enumerate(["intercept", *LOCAL])), "panel", extra=GWR_VIEWS))
def _(t: Tables) -> DataFrame:
    local = spatial_regression.gwr(local_rows(t), t.panel_place.select("station", "lon", "lat"), TARGET, LOCAL, BANDWIDTH)
    return terms(local, LOCAL, "station")


@query("gwr_all_features")
def _(t: Tables) -> DataFrame:
    base = warmed_panel(t)
    rows = panel.panel_features(base, TARGET, [COVARIATE])
    names = regression.backward_features(TARGET, [COVARIATE])
    places = base.select("station", "lon", "lat").distinct()
    return terms(spatial_regression.gwr(rows, places, TARGET, names, BANDWIDTH), names, "station")


_HOURS = f"(sqrt(0.05e0 * sqrt{_SQUARED}) + sqrt(0.95e0 * abs(t.slot - u.slot)))"
_TIMED_SUMS = ", ".join([f"sum(w * a{i}{j}) as a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(w * b{i}) as b{i}" for i in range(3)])
GTWR_VIEWS = LOCAL_VIEWS | {
    "slots": f"select *, (d - 1) * 24 + h as slot from (select *, {CALENDAR} from ft) q",
    "st2": f"select station, slot, {moment_sql(['1e0', 'l1', 'v'], 'y')} from slots where l1 is not null group by 1, 2",
    "s0": f"select station, slot, {_TIMED_SUMS} from (select t.station, t.slot, exp(-0.5e0 * pow(pow({_HOURS}, 2) / 0.2e0, 2)) as w, "
          "u.* exclude (station, slot, lon, lat) from (select *, unnest(generate_series(1, 168)) as slot from pl) t join "
          "(select * from st2 join pl using (station)) u on u.slot between t.slot - 8 and t.slot + 8) q group by 1, 2",
} | solve_views("station, slot", 3)


@query("gtwr", sql(" union all ".join(
    f"select station, slot::bigint as time, '{name}' as term, {r(f'c{i}')} as coefficient from k0"
    for i, name in enumerate(["intercept", "click_lag1", "view"])), "panel", extra=GTWR_VIEWS, kept=True))
def _(t: Tables) -> DataFrame:
    rows = local_rows(t).withColumn("time", time_of_week("ts"))
    names = [*regression.lag_names(TARGET, (1,)), COVARIATE]
    return terms(spatial_regression.gtwr(rows, t.panel_place.select("station", "lon", "lat"), TARGET, names), names, "station", "time")


@query("gtwr_filled")
def _(t: Tables) -> DataFrame:
    base = warmed_panel(t)
    rows = panel.panel_features(base, TARGET, [COVARIATE])
    names = [*regression.lag_names(TARGET, (1,)), COVARIATE]
    places = base.select("station", "lon", "lat").distinct()
    return terms(spatial_regression.gtwr(rows, places, TARGET, names), names, "station", "time")


# ---- Gamma regressions after a fixed number of passes, so that SQL can follow them

PASSES = 3
# A lead beside the lags; the fit for hours whose later values are known.
AHEAD = ["click_lag1", "click_lead1", "view"]


def weighted_sql(regressors: list[str], target: str, weight: str) -> str:
    """``moment_sql`` with a weight."""
    p = len(regressors)
    sums = [f"sum({weight} * {regressors[i]} * {regressors[j]}) as a{i}{j}" for i in range(p) for j in range(i, p)]
    return ", ".join(sums + [f"sum({weight} * {x} * {target}) as b{i}" for i, x in enumerate(regressors)])


def gamma_views(regressors: list[str], passes: int) -> dict[str, str]:
    """Identity-link Gamma fits per station: least squares, then reweighted passes. The result is in view z{passes}k0."""
    p = len(regressors)
    views = LOCAL_VIEWS | {
        "ft2": "select *, lead(y, 1) over (partition by station order by ts) as n1 from ft",
        "use": "select *, avg(y) over (partition by station) as ym from ft2 where y > 0 and "
               + " and ".join(f"{x} is not null" for x in regressors[1:])}
    eta = " + ".join(f"c{i} * {x}" for i, x in enumerate(regressors))
    for k in range(passes + 1):
        if k:
            views[f"w{k}"] = (f"select use.*, 1e0 / pow(greatest({eta}, 0.1e0 * ym), 2) as w from use "
                              f"join z{k - 1}k0 on z{k - 1}k0.station = use.station")
        source, weight = (f"w{k}", "w") if k else ("use", "1e0")
        made = {"s0": f"select station, {weighted_sql(regressors, 'y', weight)} from {source} group by 1"} | solve_views("station", p)
        views |= renamed(made, f"z{k}")
    return views


def gamma_terms(names: list[str]) -> str:
    return " union all ".join(f"select station, '{n}' as term, {r(f'c{i}')} as coefficient from z{PASSES}k0"
                              for i, n in enumerate(["intercept", *names]))


@query("glm_gamma_station_passes", sql(gamma_terms(LOCAL), "panel", extra=gamma_views(["1e0", "l1", "l2", "v"], PASSES), kept=True))
def _(t: Tables) -> DataFrame:
    return terms(regression.gamma_glm(local_rows(t), ["station"], TARGET, LOCAL, iterations=PASSES, tolerance=None), LOCAL, "station")


@query("glm_gamma_station_fwd_passes", sql(gamma_terms(AHEAD), "panel", extra=gamma_views(["1e0", "l1", "n1", "v"], PASSES), kept=True))
def _(t: Tables) -> DataFrame:
    rows = panel.add_leads(local_rows(t), TARGET, ["station"], leads=(1,))
    return terms(regression.gamma_glm(rows, ["station"], TARGET, AHEAD, iterations=PASSES, tolerance=None), AHEAD, "station")


# ---- smooths of the hour of the week and, by station, of a covariate

TIME_KNOTS, COVARIATE_KNOTS, STRENGTH = (1.0, 43.0, 85.0, 127.0, 168.0), (0.0, 20.0, 60.0, 200.0), 0.01


def spline_sql(column: str, knots: tuple[float, ...]) -> list[str]:
    """The natural cubic basis: a straight line, then differences of bends."""
    span = knots[-1] - knots[0]
    x = f"(({column} - {knots[0]!r}e0) / {span!r}e0)"
    k = [(v - knots[0]) / span for v in knots]

    def cube(at: float) -> str:
        return f"pow(greatest({x} - {at!r}e0, 0e0), 3)"

    def bend(i: int) -> str:
        return f"({cube(k[i])} - {cube(k[-1])}) / {k[-1] - k[i]!r}e0"
    return [x] + [f"({bend(i)} - {bend(len(k) - 2)})" for i in range(len(k) - 2)]


def roughness_sql(knots: tuple[float, ...]) -> dict[tuple[int, int], str]:
    """Integrals of products of the bends' second derivatives, as a cubic in the knots: for knots a <= b the product of
    6 (x - a) and 6 (x - b), integrated from b to 1. Scaled to a trace of 1."""
    k = [(v - knots[0]) / (knots[-1] - knots[0]) for v in knots]
    last, n = len(k) - 2, len(k) - 2

    def ramp(i: int, j: int) -> float:
        low, high = min(k[i], k[j]), max(k[i], k[j])
        d = 1 - high
        return 36 * (d ** 3 / 3 + (high - low) * d ** 2 / 2) / ((1 - k[i]) * (1 - k[j]))

    def value(i: int, j: int) -> float:
        return ramp(i, j) - ramp(i, last) - ramp(last, j) + ramp(last, last)
    trace = sum(value(i, i) for i in range(n))
    return {(i + 1, j + 1): f"{value(i, j) / trace!r}e0" for i in range(n) for j in range(i, n)}


def _steps(by: str, source: str, prefix: str, steps: range, p: int, start: int, also: str = "") -> dict[str, str]:
    """Elimination of some variables from the sums a.., b.., one view per variable."""
    views = {}
    for k in steps:
        made = [by] if by else []
        for i in range(start, p):
            for j in range(i, p):
                made.append(f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} as a{i}{j}" if i > k else f"a{i}{j}")
            made.append(f"b{i} - a{k}{i} * b{k} / a{k}{k} as b{i}" if i > k else f"b{i}")
        views[f"{prefix}{k}"] = f"select {', '.join(made)}{also} from {source}"
        source = f"{prefix}{k}"
    return views


def smooth_views(passes: int) -> dict[str, str]:
    """Log-link fits with penalised smooths: stations' blocks are eliminated, the rest is summed, solved and put back."""
    own, shared = spline_sql("v", COVARIATE_KNOTS), spline_sql("slot", TIME_KNOTS)
    nl, nt = len(own), len(shared)
    p = nl + 2 + nt
    names = [f"g{i}" for i in range(nl)] + ["1e0", "l1"] + [f"t{i}" for i in range(nt)]
    strength = f"{STRENGTH!r}e0"
    local, pooled = roughness_sql(COVARIATE_KNOTS), roughness_sql(TIME_KNOTS)
    views = LOCAL_VIEWS | {
        "base": f"select station, y, l1, {', '.join(f'{e} as u{i}' for i, e in enumerate(own))}, "
                f"{', '.join(f'{e} as t{i}' for i, e in enumerate(shared))} from (select *, (d - 1) * 24 + h as slot from "
                f"(select *, {CALENDAR} from ft) q) q where y > 0 and l1 is not null and v is not null",
        "use": f"select *, {', '.join(f'u{i} - avg(u{i}) over (partition by station) as g{i}' for i in range(nl))} from base",
    }
    eta = " + ".join(f"c{i} * {x}" for i, x in enumerate(names))
    for n in range(passes + 1):
        if n:
            views[f"eta{n}"] = f"select use.*, {eta} as eta from use join back{n - 1} on back{n - 1}.station = use.station"
            views[f"z{n}"] = f"select *, eta + (y - exp(eta)) / exp(eta) as z from eta{n}"
        else:
            views["z0"] = "select *, ln(y) as z from use"
        views[f"raw{n}"] = f"select station, count(*) as n, {moment_sql(names, 'z')} from z{n} group by 1"
        made = [f"a{i}{j} + {strength} * n * {local[i, j]} as a{i}{j}" if (i, j) in local and j < nl else f"a{i}{j}"
                for i in range(p) for j in range(i, p)]
        views[f"pen{n}"] = f"select station, n, {', '.join(made)}, {', '.join(f'b{i}' for i in range(p))} from raw{n}"
        views |= _steps("station", f"pen{n}", f"el{n}_", range(nl), p, 0, ", n")
        last = f"el{n}_{nl - 1}"
        # The smooth of the hour starts behind the intercept and the lag.
        at = nl + 2
        sums = [f"sum(a{i}{j})" + (f" + {strength} * sum(n) * {pooled[i - at, j - at]}" if (i - at, j - at) in pooled else "")
                + f" as a{i}{j}" for i in range(nl, p) for j in range(i, p)]
        views[f"tot{n}"] = f"select {', '.join(sums)}, {', '.join(f'sum(b{i}) as b{i}' for i in range(nl, p))} from {last}"
        views |= _steps("", f"tot{n}", f"sh{n}_", range(nl, p - 1), p, nl)
        source = f"sh{n}_{p - 2}"
        for k in range(p - 1, nl - 1, -1):
            rest = "".join(f" - a{k}{j} * c{j}" for j in range(k + 1, p))
            views[f"so{n}_{k}"] = f"select *, (b{k}{rest}) / a{k}{k} as c{k} from {source}"
            source = f"so{n}_{k}"
        views[f"beta{n}"] = f"select {', '.join(f'c{i}' for i in range(nl, p))} from {source}"
        source = f"(select * from {last} cross join beta{n}) q"
        for k in range(nl - 1, -1, -1):
            rest = "".join(f" - a{k}{j} * c{j}" for j in range(k + 1, p))
            views[f"bk{n}_{k}"] = f"select *, (b{k}{rest}) / a{k}{k} as c{k} from {source}"
            source = f"bk{n}_{k}"
        views[f"back{n}"] = f"select station, {', '.join(f'c{i}' for i in range(p))} from {source}"
    return views


_OWN = [f"smooth_view_{i}" for i in range(len(COVARIATE_KNOTS) - 1)]
_SHARED = ["intercept", "click_lag1", *[f"smooth_time_{i}" for i in range(len(TIME_KNOTS) - 1)]]


@query("gam_smooth_station", sql(" union all ".join(
    [f"select station, '{n}' as term, {r(f'c{i}')} as coefficient from back1" for i, n in enumerate(_OWN)]
    + [f"select 'all' as station, '{n}' as term, {r(f'c{len(_OWN) + i}')} as coefficient from beta1" for i, n in enumerate(_SHARED)]),
    "panel", extra=smooth_views(1), kept=True))
def _(t: Tables) -> DataFrame:
    """A smooth of the hour of the week and one of a covariate by station, at a fixed strength, after one reweighted pass."""
    rows = local_rows(t).withColumn("time", time_of_week("ts"))
    smooths = [smooth.Smooth("time", TIME_KNOTS), smooth.Smooth(COVARIATE, COVARIATE_KNOTS, by_station=True)]
    fit = smooth.additive_gamma(rows, TARGET, ["click_lag1"], smooths, strengths={"time": STRENGTH, COVARIATE: STRENGTH},
                                iterations=1, tolerance=None)
    shared = t.spark.createDataFrame([("all", n, c) for n, c in zip(["intercept", *fit.names], fit.shared, strict=True)],
                                     "station string, term string, coefficient double")
    labels = F.array(*[F.lit(n) for n in fit.local_names])
    own = fit.local.select("station", F.explode(F.arrays_zip(labels.alias("term"), F.col("own").alias("coefficient"))).alias("_t"))
    return own.select("station", "_t.term", "_t.coefficient").unionByName(shared)


@query("gam_smooth_station_fitted")
def _(t: Tables) -> DataFrame:
    """The same terms with strengths chosen by cross-validation, passes until they settle, on the filled panel."""
    rows = _pooled_rows(t)
    smooths = [smooth.Smooth("time"), smooth.Smooth(COVARIATE, COVARIATE_KNOTS, by_station=True)]
    fit = smooth.additive_gamma(rows, TARGET, [*regression.lag_names(TARGET, panel.LONG_LAGS), SECOND_COVARIATE], smooths,
                                fold=F.xxhash64(F.to_date("ts")))
    return smooth.with_fitted(rows, fit, smooths).select("station", "ts", "fitted")


CANDIDATES = [0.2, 0.3, 0.478, 1.0]
_GRAM = " + ".join(f"{1 if i == j else 2} * c{i} * c{j} * st.a{i}{j}" for i in range(4) for j in range(i, 4))
_CROSS = " + ".join(f"c{i} * st.b{i}" for i in range(4))
CV_VIEWS = LOCAL_VIEWS | {
    "s0": f"select h, station, {_SUMS} from (select h, t.station, exp(-0.5e0 * {_SQUARED} / pow(h, 2)) as w, st.* exclude (station) "
          "from (select unnest([0.2e0, 0.3e0, 0.478e0, 1e0]) as h) c cross join pl t cross join st join pl u "
          "on u.station = st.station where u.station <> t.station) q group by 1, 2",
} | solve_views("h, station", 4)


@query("bandwidth_cv", sql(
    f"select h as bandwidth, {r(f'sum(yy - 2 * ({_CROSS}) + {_GRAM}) / sum(yy)')} as cv_share from k0 join st using (station) group by 1",
    "panel", extra=CV_VIEWS))
def _(t: Tables) -> DataFrame:
    rows = local_rows(t)
    total = rows.where(F.col("click_lag2").isNotNull()).agg(F.sum(F.col(TARGET) * F.col(TARGET))).scalar()
    scores = spatial_regression.bandwidth_cv(rows, TARGET, LOCAL, CANDIDATES)
    return scores.select("bandwidth", (F.col("cv_error") / total).alias("cv_share"))


TIMED_CANDIDATES = [0.2, 0.3, 0.45]
_TIMED_GRAM = " + ".join(f"{1 if i == j else 2} * c{i} * c{j} * st2.a{i}{j}" for i in range(3) for j in range(i, 3))
_TIMED_CROSS = " + ".join(f"c{i} * st2.b{i}" for i in range(3))
TIMED_CV_VIEWS = GTWR_VIEWS | {
    "st2": f"select station, slot, sum(y * y) as yy, {moment_sql(['1e0', 'l1', 'v'], 'y')} from slots where l1 is not null group by 1, 2",
    "s0": f"select h, station, slot, {_TIMED_SUMS} from (select h, t.station, t.slot, exp(-0.5e0 * pow(pow({_HOURS}, 2) / h, 2)) as w, "
          "u.* exclude (station, slot, lon, lat, yy) from (select unnest([0.2e0, 0.3e0, 0.45e0]) as h) c cross join "
          "(select * from st2 join pl using (station)) t join (select * from st2 join pl using (station)) u "
          "on u.slot between t.slot - 18 and t.slot + 18 and u.station <> t.station) q group by 1, 2, 3",
} | solve_views("h, station, slot", 3)


@query("bandwidth_cv_time", sql(
    f"select h as bandwidth, {r(f'sum(yy - 2 * ({_TIMED_CROSS}) + {_TIMED_GRAM}) / sum(yy)')} as cv_share "
    "from k0 join st2 using (station, slot) group by 1", "panel", extra=TIMED_CV_VIEWS, kept=True))
def _(t: Tables) -> DataFrame:
    """Bandwidths of the kernel in space and time."""
    rows = local_rows(t).withColumn("time", time_of_week("ts"))
    names = [*regression.lag_names(TARGET, (1,)), COVARIATE]
    total = rows.where(F.col("click_lag1").isNotNull()).agg(F.sum(F.col(TARGET) * F.col(TARGET))).scalar()
    scores = spatial_regression.bandwidth_cv(rows, TARGET, names, TIMED_CANDIDATES, time="time")
    return scores.select("bandwidth", (F.col("cv_error") / total).alias("cv_share"))


SEARCH_LOW, SEARCH_HIGH, SEARCH_POINTS, SEARCH_ROUNDS = 0.2, 1.6, 4, 3


def search_views() -> dict[str, str]:
    """An interval search, one set of views a round; the next interval lies between the neighbours of the best."""
    views = dict(LOCAL_VIEWS)
    bounds = f"select {SEARCH_LOW}e0 as low, {SEARCH_HIGH}e0 as high"
    for n in range(1, SEARCH_ROUNDS + 1):
        views[f"grid{n}"] = (f"select i, low * pow(high / low, i / {SEARCH_POINTS - 1}e0) as h from ({bounds}) b, "
                             f"(select unnest(generate_series(0, {SEARCH_POINTS - 1})) as i) q")
        made = {"s0": f"select i, station, {_SUMS} from (select i, t.station, exp(-0.5e0 * {_SQUARED} / pow(h, 2)) as w, st.* exclude "
                      f"(station) from grid{n} c cross join pl t cross join st join pl u on u.station = st.station "
                      "where u.station <> t.station) q group by 1, 2"} | solve_views("i, station", 4)
        views |= renamed(made, f"r{n}")
        views[f"score{n}"] = (f"select i, any_value(h) as h, sum(yy - 2 * ({_CROSS}) + {_GRAM}) / sum(yy) as e from r{n}k0 "
                              f"join st using (station) join grid{n} using (i) group by 1")
        views[f"best{n}"] = f"select i from score{n} order by e, i limit 1"
        bounds = (f"select min(h) as low, max(h) as high from grid{n} "
                  f"where i between (select i from best{n}) - 1 and (select i from best{n}) + 1")
    return views


@query("bandwidth_search", sql(" union all ".join(
    f"select {n}::bigint as round, {r('h')} as bandwidth, {r('e')} as cv_share from score{n}" for n in range(1, SEARCH_ROUNDS + 1)),
    "panel", extra=search_views(), kept=True))
def _(t: Tables) -> DataFrame:
    rows = local_rows(t)
    total = rows.where(F.col("click_lag2").isNotNull()).agg(F.sum(F.col(TARGET) * F.col(TARGET))).scalar()
    scores = spatial_regression.bandwidth_search(rows, TARGET, LOCAL, SEARCH_LOW, SEARCH_HIGH, SEARCH_POINTS, SEARCH_ROUNDS)
    return scores.select("round", "bandwidth", (F.col("cv_error") / total).alias("cv_share"))


# ---- recursive fills from local coefficients: refitted by the day, or by hour of the week with a model that sees ahead

WINDOW_DAYS, REFIT_DAYS = 7, 3
_RAW = ("select station, ts, x as y, v, cast(ts as date) as dy, row_number() over (partition by station order by ts) as i, lead(x) "
        "over (partition by station order by ts) as n1 from panel join (select station, ts, max(x) as v from carried where "
        "pollutant = 'view' group by 1, 2) q using (station, ts) where pollutant = 'click'")
_FIELDS = ", ".join([f"a{i}{j}" for i in range(4) for j in range(i, 4)] + [f"b{i}" for i in range(4)])
DAILY_VIEWS = LOCAL_VIEWS | {
    "byday": f"select station, cast(ts as date) as dy, {moment_sql(['1e0', 'l1', 'l2', 'v'], 'y')} from ft "
             "where l1 is not null and l2 is not null group by 1, 2",
    "served": f"select station, cast(dy + cast(n as int) as date) as rd, {_FIELDS} from byday cross join "
              f"(select unnest(generate_series(1, {WINDOW_DAYS})) as n) q",
    "win": f"select station, rd, {', '.join(f'sum({f}) as {f}' for f in _FIELDS.split(', '))} from served "
           f"where datediff('day', date '1970-01-01', rd) % {REFIT_DAYS} = 0 group by 1, 2",
    "s0": f"select station, rd, {_SUMS} from (select t.station, exp(-0.5e0 * {_SQUARED} / pow({BANDWIDTH}e0, 2)) as w, win.* exclude "
          "(station) from pl t cross join win join pl u on u.station = win.station) q group by 1, 2",
} | solve_views("station, rd", 4) | {
    "rf": _RAW,
    "rc": "select rf.*, c0, c1, c2, c3 from rf asof left join k0 on rf.station = k0.station and rf.dy >= k0.rd",
    "fold(station, i, a, b)": "select station, i, y, cast(null as double) from rc where i = 1 union all "
        "select f.station, q.i, coalesce(q.y, case when g <= 0 then 1e-2 else g end), f.a from fold f join "
        "lateral (select i, y, c0 + c1 * f.a + c2 * f.b + c3 * v as g from rc where rc.station = f.station "
        "and rc.i = f.i + 1) q on true",
}


def _raw_target(t: Tables) -> DataFrame:
    """The target with its gaps and lags, beside the carried covariate."""
    done = panel.locf(t.panel.where(F.col("pollutant") == COVARIATE)).select("station", "ts", F.col("x").alias(COVARIATE))
    target = t.panel.where(F.col("pollutant") == TARGET).select("station", "ts", F.col("x").alias(TARGET))
    return panel.add_lags(target.join(done, ["station", "ts"]), TARGET, ["station"], lags=(1, 2))


def recursive_sql(body: str, views: dict[str, str]) -> str:
    """``sql`` with a recursive view; everything before it is stored."""
    plain = {n: v for n, v in views.items() if "(" not in n}
    folds = ", ".join(f"{n} as ({v})" for n, v in views.items() if "(" in n)
    return sql(f"@@{body}", "panel", extra=plain, kept=True).replace("with ", "with recursive ", 1).replace(" @@", f", {folds} ", 1)


@query("gwr_daily_fill", recursive_sql(
    f"select station, {stamp('ts')} as ts, {r('a')} as click from fold join rf using (station, i)", DAILY_VIEWS))
def _(t: Tables) -> DataFrame:
    """Refitted every third day on the seven days before; a missing hour takes the newest coefficients of its station."""
    tables = spatial_regression.daily_coefficients(
        local_rows(t), t.panel_place.select("station", "lon", "lat"), TARGET, LOCAL, BANDWIDTH, WINDOW_DAYS, REFIT_DAYS)
    rows = _raw_target(t).withColumn("day", F.to_date("ts"))
    x = F.array(*regression.design(LOCAL))
    filled = recursion.local_fill(rows, ["station"], "ts", TARGET, x, {1: 1, 2: 2}, tables, at="day", newest=True)
    return filled.select("station", "ts", TARGET)


GTWR_FILL_VIEWS = GTWR_VIEWS | {
    "ft2": "select *, lead(y, 1) over (partition by station order by ts) as n1 from ft",
    "st3": f"select station, {moment_sql(['1e0', 'l1', 'n1', 'v'], 'y')} from ft2 where l1 is not null and n1 is not null group by 1",
} | renamed({
    "s0": f"select station, {_SUMS} from (select t.station, exp(-0.5e0 * {_SQUARED} / pow({BANDWIDTH}e0, 2)) as w, st3.* exclude "
          "(station) from pl t cross join st3 join pl u on u.station = st3.station) q group by 1",
} | solve_views("station", 4), "z") | {
    "rf": _RAW,
    "rc": "select q.*, k0.c0 as e0, k0.c1 as e1, k0.c2 as e2, z.c0, z.c1, z.c2, z.c3 from (select *, (d - 1) * 24 + h as slot "
          f"from (select *, {CALENDAR} from rf) o) q left join k0 on k0.station = q.station and k0.slot = q.slot "
          "left join zk0 z on z.station = q.station",
    "fold(station, i, a)": "select station, i, y from rc where i = 1 union all "
        "select f.station, q.i, coalesce(q.y, case when g <= 0 then 1e-2 else g end) from fold f join lateral (select i, y, "
        "case when n1 is not null then c0 + c1 * f.a + c2 * n1 + c3 * v else e0 + e1 * f.a + e2 * v end as g "
        "from rc where rc.station = f.station and rc.i = f.i + 1) q on true",
}


@query("gtwr_fill", recursive_sql(
    f"select station, {stamp('ts')} as ts, {r('a')} as click from fold join rf using (station, i)", GTWR_FILL_VIEWS))
def _(t: Tables) -> DataFrame:
    """Coefficients by hour of the week in space and time; where the next hour is known, a local model that uses it."""
    places = t.panel_place.select("station", "lon", "lat")
    known = panel.add_leads(local_rows(t), TARGET, ["station"], leads=(1,)).withColumn("time", time_of_week("ts"))
    names = [*regression.lag_names(TARGET, (1,)), COVARIATE]
    tables = spatial_regression.gtwr(known, places, TARGET, names)
    later = spatial_regression.gwr(known, places, TARGET, AHEAD, BANDWIDTH)
    rows = panel.add_leads(_raw_target(t), TARGET, ["station"], leads=(1,)).withColumn("time", time_of_week("ts"))
    forward = (later, F.array(*regression.design(AHEAD)), F.col("click_lead1").isNotNull())
    filled = recursion.local_fill(rows, ["station"], "ts", TARGET, F.array(*regression.design(names)), {1: 1}, tables,
                                  at="time", forward=forward)
    return filled.select("station", "ts", TARGET)


@query("recursive_impute")
def _(t: Tables) -> DataFrame:
    return recursion.glm_fill(warmed_panel(t), TARGET, [COVARIATE]).select("station", "ts", TARGET)


# Given coefficients: intercept, two lags of the target, the carried covariate at the hour.
GIVEN = (-0.5, 0.6, 0.3, 0.1)
FOLD_VIEWS = {
    "carried": LOCAL_VIEWS["carried"],
    "cv": "select station, ts, max(x) as v from carried where pollutant = 'view' group by 1, 2",
    "rf": "select station, ts, x as y, v, row_number() over (partition by station order by ts) as i "
          "from panel join cv using (station, ts) where pollutant = 'click'",
    "fold(station, i, a, b)": "select station, i, y, cast(null as double) from rf where i = 1 union all "
        "select f.station, q.i, coalesce(q.y, case when g <= 0 then 1e-2 else g end), f.a from fold f join "
        "lateral (select i, y, -0.5e0 + 0.6e0 * f.a + 0.3e0 * f.b + 0.1e0 * v as g from rf where rf.station = f.station "
        "and rf.i = f.i + 1) q on true",
}


@query("recursive_fill_given", sql(
    f"select station, {stamp('ts')} as ts, {r('a')} as click from fold join rf using (station, i)", "panel",
    extra=FOLD_VIEWS).replace("with ", "with recursive ", 1))
def _(t: Tables) -> DataFrame:
    """The fill of the whole target panel under given coefficients; a filled hour feeds the next two."""
    done = panel.locf(t.panel.where(F.col("pollutant") == COVARIATE)).select("station", "ts", F.col("x").alias(COVARIATE))
    target = t.panel.where(F.col("pollutant") == TARGET).select("station", "ts", F.col("x").alias(TARGET))
    rows = panel.add_lags(target.join(done, ["station", "ts"]), TARGET, ["station"], lags=(1, 2))
    x = F.array(*regression.design([f"{TARGET}_lag1", f"{TARGET}_lag2", COVARIATE]))
    beta = F.array(*[F.lit(b) for b in GIVEN])
    return recursion.recursive_fill(rows, ["station"], "ts", TARGET, x, {1: 1, 2: 2}, beta).select("station", "ts", TARGET)


_LEADS = " and ".join(f'lead("{c}", {k}) over (partition by station order by ts) is not null'
                     for c in (TARGET, COVARIATE) for k in (1, 2, 3))


@query("choose_forward_model", sql(
    f"select station, {stamp('ts')} as ts, forward from (select station, ts, click, {_LEADS} as forward from pw) q "
    "where click is null", "pw"))
def _(t: Tables) -> DataFrame:
    wide = aggregate.pivot_wider(t.panel, ["station", "ts"], "pollutant", [TARGET, COVARIATE], F.max("x"))
    rows = panel.panel_features(wide, TARGET, [COVARIATE])
    return rows.where(F.col(TARGET).isNull()).select(
        "station", "ts", recursion.choose_forward_model(TARGET, [COVARIATE]).alias("forward"))


@query("rolling_refit")
def _(t: Tables) -> DataFrame:
    return rolling.rolling_refit(model_panel(t), TARGET, [COVARIATE, SECOND_COVARIATE]).select("station", "ts", TARGET)


@query("rolling_refit_terms")
def _(t: Tables) -> DataFrame:
    """With a smooth of the hour of the week, the station type and a log link."""
    rows = model_panel(t).withColumn("time", time_of_week("ts"))
    return rolling.rolling_refit(rows, TARGET, [COVARIATE, SECOND_COVARIATE], link="log", factor="type",
                                 smooths=[smooth.Smooth("time", TIME_KNOTS)], iterations=3).select("station", "ts", TARGET)


@query("compare_methods")
def _(t: Tables) -> DataFrame:
    base = complete_panel(t)
    mask = evaluation.inject_gaps(t.panel_obs, SCENARIOS, SEED).checkpoint()
    return evaluation.compare_methods(base, mask, SCENARIOS, TARGET, [COVARIATE], BANDWIDTH)
