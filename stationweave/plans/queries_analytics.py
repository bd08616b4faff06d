"""Queries over aggregation, summaries, ordered operations, interpolation and imputation."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions import columns as C
from stationweave.operators import (
    aggregate, effects, evaluation, interpolate, panel, stations, summary, zones,
)
from stationweave.plans.binding import POLLUTANTS, Tables
from stationweave.plans.oracle_views import KM, LOCAL, PARTS, day, r, sql, stamp
from stationweave.plans.registry import query
from stationweave.session import ensure_checkpoint_dir

# ---- aggregation

WIDE_ROUNDED = ", ".join(f'{r(chr(34) + p + chr(34))} as "{p}"' for p in PARTS)


@query("pivot_measurements", sql(
    f"select station, averaging_time, {stamp('begin_ts')} as begin_ts, {stamp('end_ts')} as end_ts, "
    + ", ".join(
        f"case when count(case when pollutant = '{p}' then 1 end) = count(case when pollutant = '{p}' then c end) then "
        f"{r(f'''avg(case when pollutant = '{p}' then c end)''')} end as \"{p}\"" for p in PARTS)
    + " from (select *, case when concentration >= 0 then concentration end as c from obs) q group by 1, 2, begin_ts, end_ts",
    "obs"))
def _(t: Tables) -> DataFrame:
    holes = t.obs.withColumn("concentration", F.when(F.col("concentration") >= 0, F.col("concentration")))
    return aggregate.pivot_measurements(holes, POLLUTANTS)


PERIOD = {
    "yearly": day(f"date_trunc('year', {LOCAL})"),
    "monthly": day(f"date_trunc('month', {LOCAL})"),
    "weekly": day(f"date_trunc('week', {LOCAL})"),
    "daily": day(LOCAL),
    "hourly": stamp(f"date_trunc('hour', {LOCAL})"),
}
STATISTIC = {
    "mean": "avg(concentration)", "min": "min(concentration)", "max": "max(concentration)",
    "median": "quantile_cont(concentration, 0.5)", "sd": "stddev_samp(concentration)",
    "var": "var_samp(concentration)", "quantile_0.9": "quantile_cont(concentration, 0.9)",
    "quantile_0.25": "quantile_cont(concentration, 0.25)",
}


def _taggr_sql(frequency: str, functions: list[str]) -> str:
    stats = ", ".join(f'{r(STATISTIC[f])} as "{f}"' for f in functions)
    return sql(f"select station, pollutant, {PERIOD[frequency]} as date, {stats} from obs group by 1, 2, 3", "obs")


def _taggr(name: str, frequency: str, functions: list[str]) -> None:
    @query(name, _taggr_sql(frequency, functions))
    def _(t: Tables) -> DataFrame:
        return aggregate.time_aggregate(t.obs, frequency, functions)


for _frequency in PERIOD:
    _taggr(f"taggr_{_frequency}", _frequency, ["mean", "min", "max"])
for _name in ("mean", "min", "max", "median", "sd", "var"):
    _taggr(f"agg_{_name}", "daily", [_name])
_taggr("agg_quantile", "monthly", ["quantile_0.9", "quantile_0.25"])
_taggr("taggr_weekly_all_functions", "weekly", ["mean", "median", "quantile_0.9", "sd", "max"])


@query("taggr_multi", sql(
    f"select station, {PERIOD['monthly']} as date, " + ", ".join(
        r(STATISTIC[f].replace("concentration", f"case when pollutant = '{p}' then concentration end")) + f' as "{p}_{f}"'
        for p in ("click", "view") for f in ("mean", "quantile_0.9", "max"))
    + " from obs group by 1, 2", "obs"))
def _(t: Tables) -> DataFrame:
    functions = ["mean", "quantile_0.9", "max"]
    long = aggregate.time_aggregate(t.obs, "monthly", functions)
    return aggregate.time_aggregate_wide(long, ["click", "view"], functions)


@query("taggr_by_pollutant", sql(
    f"select station, {PERIOD['weekly']} as date, {r('avg(concentration)')} as mean from obs "
    "where pollutant = 'view' group by 1, 2", "obs"))
def _(t: Tables) -> DataFrame:
    long = aggregate.time_aggregate(t.obs, "weekly", ["mean"])
    return aggregate.time_aggregate_by_pollutant(long, ["click", "view"])["view"]


@query("merge_aggregates", sql(
    f"select station, {PERIOD['daily']} as date, " + ", ".join(
        r(f"avg(case when pollutant = '{p}' then concentration end)") + f' as "{p}_mean"' for p in PARTS)
    + " from obs group by 1, 2", "obs"))
def _(t: Tables) -> DataFrame:
    return aggregate.time_aggregate_wide(aggregate.time_aggregate(t.obs, "daily", ["mean"]), POLLUTANTS, ["mean"])


# The flagship flow: year filter, pivot, names, monthly statistics of every pollutant.
FLAGSHIP_SQL = sql(
    f"select l.station, s.station_name, pollutant, {PERIOD['monthly']} as date, {r('avg(x)')} as mean, {r('min(x)')} as min, "
    f"{r('max(x)')} as max from long l left join station s on s.station = l.station where year(begin_ts) = 2024 "
    "group by 1, 2, 3, 4", "long", "station")


@query("monthly_report", FLAGSHIP_SQL)
def flagship(t: Tables) -> DataFrame:
    from stationweave.sources.readers import filter_years
    wide = aggregate.pivot_measurements(filter_years(t.obs, 2024, 2024), POLLUTANTS)
    named = stations.attach_station_name(wide, t.station)
    return aggregate.time_aggregate(aggregate.pivot_longer(named, POLLUTANTS), "monthly")


def _effect(t: Tables, kind: str) -> DataFrame:
    return effects.bucket_effects(t.panel).where(F.col("kind") == kind).drop("kind")


def _effect_sql(expression: str) -> str:
    return sql(
        f"select pollutant, station, bucket, {r('m - avg(m) over (partition by pollutant, bucket)')} as effect from "
        f"(select pollutant, station, {expression}::bigint as bucket, avg(x) as m from panel where x is not null "
        "group by 1, 2, 3) q", "panel")


def _register_effect(name: str, kind: str, expression: str) -> None:
    @query(name, _effect_sql(expression))
    def _(t: Tables) -> DataFrame:
        return _effect(t, kind)


_register_effect("effect_week", "week", "(floor((dayofyear(ts) - 1) / 7) + 1)")
_register_effect("effect_weekday", "weekday", "(dayofweek(ts) + 1)")
_register_effect("effect_hour", "hour", "(hour(ts) + 1)")


# ---- summary

@query("dataset_counters", sql(
    "select count(*)::bigint as rows, count(distinct station)::bigint as stations, "
    f"count(distinct begin_ts)::bigint as timestamps, {stamp('min(begin_ts)')} as first_ts, {stamp('max(begin_ts)')} as last_ts "
    "from wide", "wide"))
def _(t: Tables) -> DataFrame:
    return summary.dataset_counters(t.wide)


@query("summary_global", sql(
    "select pollutant, count(*) filter (x is null)::bigint as na_count, "
    f"{r('count(*) filter (x is null) * 100e0 / count(*)')} as na_perc, count(*) filter (x < 0)::bigint as negative, "
    f"{r('min(case when x >= 0 then x end)')} as min, {r('avg(x)')} as mean, {r('max(x)')} as max, {r('stddev_samp(x)')} as sd "
    "from long group by 1", "long"))
def _(t: Tables) -> DataFrame:
    return summary.summary_global(t.wide, POLLUTANTS)


SUMMARY = {
    "na_count": "count(*) filter (x is null)::bigint", "na_perc": r("count(*) filter (x is null) * 100e0 / count(*)"),
    "negative": "count(*) filter (x < 0)::bigint", "min": r("min(x)"), "mean": r("avg(x)"), "max": r("max(x)"),
    "sd": r("stddev_samp(x)"),
}


def _summary(statistic: str) -> None:
    @query(f"summary_{statistic}", sql(
        f"select station, pollutant, {SUMMARY[statistic]} as {statistic} from long group by 1, 2", "long"))
    def _(t: Tables) -> DataFrame:
        return summary.summary_statistic(t.wide, POLLUTANTS, statistic)


for _statistic in SUMMARY:
    _summary(_statistic)


@query("summary_by_station", sql(
    "select station, pollutant, " + ", ".join(f"{e} as {n}" for n, e in SUMMARY.items()) + " from long group by 1, 2", "long"))
def _(t: Tables) -> DataFrame:
    return summary.summary_by_station(t.wide, POLLUTANTS)


@query("summary_averaging_time", sql(
    "select station, pollutant, string_agg(distinct a, ', ' order by a) as averaging_times from (select *, "
    "case when hour(begin_ts) < 6 then 'day' else 'hour' end as a from long) q where x is not null group by 1, 2", "long"))
def _(t: Tables) -> DataFrame:
    mixed = t.wide.withColumn("averaging_time", F.when(F.hour("begin_ts") < 6, "day").otherwise("hour"))
    return summary.summary_averaging_time(mixed, POLLUTANTS)


_OBSERVED = """m as (select *, min(ts) over (partition by station, pollutant) as a,
    max(ts) over (partition by station, pollutant) as b from panel),
    o as (select station, pollutant, ts, lead(ts) over (partition by station, pollutant order by ts) as nx from m
          where x is not null or ts = a or ts = b),
    g as (select station, pollutant, ts, nx, (epoch(nx) - epoch(ts)) / 3600e0 as gap from o)"""


@query("gap_length", sql(
    f"select * from (with {_OBSERVED} select station, pollutant, min(gap) as min_gap, {r('quantile_cont(gap, 0.25)')} as q25_gap, "
    f"round(avg(gap), 3) as mean_gap, {r('quantile_cont(gap, 0.5)')} as median_gap, {r('quantile_cont(gap, 0.75)')} as q75_gap, "
    "max(gap) as max_gap, round(stddev_samp(gap), 3) as sd_gap from g where gap > 0 group by 1, 2) z", "panel"))
def _(t: Tables) -> DataFrame:
    return summary.gap_length(t.panel)


@query("observation_gap", sql(
    f"select * from (with {_OBSERVED} select station, pollutant, {stamp('ts')} as ts, {stamp('nx')} as next_ts, "
    f"{r('gap')} as gap_hours from g) z", "panel"))
def _(t: Tables) -> DataFrame:
    return summary.observation_gaps(t.panel, ["station", "pollutant"], "ts", "x", chunk_hours=24)


@query("boundary_fill", sql(
    f"select station, pollutant, {stamp('ts')} as ts from (select *, min(ts) over (partition by station, pollutant) as a, "
    "max(ts) over (partition by station, pollutant) as b from panel) q where x is not null or ts = a or ts = b", "panel"))
def _(t: Tables) -> DataFrame:
    return summary.observation_gaps(t.panel, ["station", "pollutant"], "ts", "x").select("station", "pollutant", "ts")


@query("corr_matrix", sql(" union all ".join(
    f"select station, '{a}' as pollutant_1, '{b}' as pollutant_2, " + (
        f"case when var_pop(\"{a}\") > 0 then 1e0 end" if a == b else
        f"case when isfinite(corr(\"{a}\", \"{b}\")) then {r(f'corr({chr(34)}{a}{chr(34)}, {chr(34)}{b}{chr(34)})')} end")
    + " as correlation from pw group by 1" for a in PARTS for b in PARTS), "pw"))
def _(t: Tables) -> DataFrame:
    wide = aggregate.pivot_wider(t.panel, ["station", "ts"], "pollutant", POLLUTANTS, F.max("x"))
    return summary.corr_matrix(wide, POLLUTANTS)


# ---- ordered operations

_W = "over (partition by station, pollutant order by ts)"


@query("lags", sql(
    f"select station, pollutant, {stamp('ts')} as ts, " + ", ".join(
        f"{r(f'lag(x, {k}) {_W}')} as x_lag{k}" for k in (1, 2, 3, 4, 5, 24, 168)) + " from panel", "panel"))
def _(t: Tables) -> DataFrame:
    return panel.add_lags(t.panel, "x", lags=(1, 2, 3, 4, 5, 24, 168)).drop("x")


@query("leads", sql(
    f"select station, pollutant, {stamp('ts')} as ts, " + ", ".join(
        f"{r(f'lead(x, {k}) {_W}')} as x_lead{k}" for k in (1, 2, 3)) + " from panel", "panel"))
def _(t: Tables) -> DataFrame:
    return panel.add_leads(t.panel, "x").drop("x")


LOCF_SQL = ("coalesce(last_value(x ignore nulls) over (partition by station, pollutant order by ts rows between unbounded "
            "preceding and current row), first_value(x ignore nulls) over (partition by station, pollutant order by ts rows "
            "between current row and unbounded following))")


@query("locf", sql(f"select station, pollutant, {stamp('ts')} as ts, {r(LOCF_SQL)} as x from panel", "panel"))
def _(t: Tables) -> DataFrame:
    return panel.locf(t.panel, chunk_hours=24)


def _features_sql(where: str = "") -> str:
    w = "over (partition by station order by ts)"
    made = [f"lag(\"{c}\", {k}) {w} as {c}_lag{k}" for c in ("click", "view") for k in (1, 2, 3, 4, 5)]
    made += [f"lead(\"{c}\", {k}) {w} as {c}_lead{k}" for c in ("click", "view") for k in (1, 2, 3)]
    names = [m.split(" as ")[1] for m in made]
    inner = f"select station, ts, click, \"view\" as view_t, {', '.join(made)} from pw"
    return sql(f"select station, {stamp('ts')} as ts, {r('click')} as click, {r('view_t')} as \"view\", "
               + ", ".join(f"{r(n)} as {n}" for n in names)
               + f", (dayofweek(ts) * 24 + hour(ts) + 1)::bigint as time from ({inner}) q {where}", "pw")


def _features(t: Tables) -> DataFrame:
    wide = aggregate.pivot_wider(t.panel, ["station", "ts"], "pollutant", ["click", "view"], F.max("x"))
    return panel.panel_features(wide, "click", ["view"])


@query("panel_features", _features_sql())
def _(t: Tables) -> DataFrame:
    return _features(t)


@query("filter_complete_lags", _features_sql(
    "where click is not null and click_lag1 is not null and click_lag2 is not null and view_lag1 is not null"))
def _(t: Tables) -> DataFrame:
    return panel.filter_complete_lags(_features(t), ["click", "click_lag1", "click_lag2", "view_lag1"])


@query("train_window", sql(
    f"select station, pollutant, {stamp('ts')} as ts, {r('x')} as x from panel where ts >= timestamp '2024-01-15' - "
    "interval 168 hour and ts < timestamp '2024-01-15'", "panel"))
def _(t: Tables) -> DataFrame:
    return panel.training_window(t.panel, "2024-01-15")


@query("distinct_hours_sorted", sql(f"select distinct {stamp('ts')} as ts from panel where x is null", "panel"))
def _(t: Tables) -> DataFrame:
    return panel.distinct_hours_sorted(t.panel)


# ---- interpolation

STEP, PARENT = 0.5, "XX12"


def _cells_sql(zone_filter: str, step: float = STEP) -> dict[str, str]:
    return {
        "picked": f"select * from zone where {zone_filter}",
        "box": "select floor(min(x0)) as gx, floor(max(x1)) + 1 as hx, floor(min(y0)) as gy, floor(max(y1)) + 1 as hy from picked",
        "cells": f"select a.n as i, b.n as j, gx + {step}e0 * a.n as x, gy + {step}e0 * b.n as y from box, ints a, ints b "
                 f"where a.n <= floor((hx - gx) / {step}e0 + 1e-6) and b.n <= floor((hy - gy) / {step}e0 + 1e-6)",
        "inside": "select cells.*, min(zone_id) as zone_id from cells join picked on x >= x0 and x < x1 and y >= y0 and y < y1 "
                  "group by i, j, x, y",
    }


VALUES_SQL = ("select o.station, date_trunc('day', begin_ts) as date, lon, lat, avg(concentration) as value from obs o "
              "join station t on t.station = o.station where pollutant = 'view' group by 1, 2, 3, 4")


def _all_zones(t: Tables) -> DataFrame:
    return zones.prepare_zones(t.zone)


_PICK = "true"


def _cells(t: Tables) -> DataFrame:
    ready = _all_zones(t)
    return interpolate.grid_mask(interpolate.make_grid(ready, STEP), ready)


def _values(t: Tables) -> DataFrame:
    daily = (t.obs.where("pollutant = 'view'")
             .groupBy("station", F.date_trunc("day", "begin_ts").alias("date"))
             .agg(F.avg("concentration").alias("value")))
    return stations.attach_coordinates(daily, t.station).where(F.col("lon").isNotNull())


@query("zone_bbox_area", sql(
    f"select min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, round(sum(radians(x1 - x0) * (sin(radians(y1)) - "
    f"sin(radians(y0))) * pow(6371008.8e0, 2)) / 1e6, 6) as area_km2 from zone where {_PICK}", "zone"))
def _(t: Tables) -> DataFrame:
    return zones.zone_bbox_area(_all_zones(t)).select("x0", "y0", "x1", "y1", (F.col("area_m2") / 1e6).alias("area_km2"))


@query("grid_resolution", sql(
    "select zone_id, case when a < 5e8 then 0.0025e0 when a < 1e9 then 0.005e0 else 0.01e0 end as step from (select zone_id, "
    "radians(x1 - x0) * (sin(radians(y1)) - sin(radians(y0))) * pow(6371008.8e0, 2) * case when zone_id like '%0' then 0.01e0 "
    "when zone_id like '%1' then 0.025e0 else 1e0 end as a from zone) q", "zone"))
def _(t: Tables) -> DataFrame:
    from stationweave.functions import geometry
    shrink = F.when(F.col("zone_id").endswith("0"), 0.01).when(F.col("zone_id").endswith("1"), 0.025).otherwise(1.0)
    return t.zone.select("zone_id", interpolate.grid_resolution(geometry.area_m2(F.col("rings")) * shrink).alias("step"))


@query("make_grid", sql(f"select i, j, {r('x')} as x, {r('y')} as y from cells", "zone", "ints", extra=_cells_sql(_PICK, 0.05)))
def _(t: Tables) -> DataFrame:
    return interpolate.make_grid(_all_zones(t), 0.05).select("i", "j", "x", "y")


@query("grid_mask", sql(
    f"select i, j, {r('x')} as x, {r('y')} as y, zone_id from inside", "zone", "ints", extra=_cells_sql(_PICK, 0.05)))
def _(t: Tables) -> DataFrame:
    ready = _all_zones(t)
    return interpolate.grid_mask(interpolate.make_grid(ready, 0.05), ready).select("i", "j", "x", "y", "zone_id")


def _idw_sql(where: str = "", ranked: bool = False, idp: str = "2") -> str:
    extra = _cells_sql(_PICK) | {
        "vals": VALUES_SQL,
        "d": f"select date, i, j, x, y, station, value, {KM} as km from vals cross join inside",
        "e": "select *, row_number() over (partition by date, i, j order by km, station) as rn from d",
        "w": f"select *, 1 / pow(greatest(km, 1e-9), {idp}) as w from {'e' if ranked else 'd'} {where}",
        "est": "select date, i, j, coalesce(max(case when km < 1e-9 then value end), sum(w * value) / sum(w)) as z from w group by 1, 2, 3",
    }
    return sql(f"select {stamp('f.date')} as date, f.i, f.j, {r('f.x')} as x, {r('f.y')} as y, {r('z')} as value "
               "from (select q.date, c.i, c.j, c.x, c.y from (select distinct date from vals) q cross join inside c) f "
               "left join est on est.date = f.date and est.i = f.i and est.j = f.j",
               "obs", "station", "zone", "ints", extra=extra)


@query("idw", _idw_sql())
def _(t: Tables) -> DataFrame:
    return interpolate.idw(_values(t), _cells(t))


@query("idw_power", _idw_sql(idp="3"))
def _(t: Tables) -> DataFrame:
    return interpolate.idw(_values(t), _cells(t), idp=3)


@query("idw_nmax", _idw_sql("where rn <= 3", True))
def _(t: Tables) -> DataFrame:
    return interpolate.idw(_values(t), _cells(t), nmax=3)


@query("idw_maxdist", _idw_sql("where km <= 120"))
def _(t: Tables) -> DataFrame:
    return interpolate.idw(_values(t), _cells(t), maxdist=120)


@query("idw_nmax_maxdist", _idw_sql("where rn <= 3 and km <= 120", True))
def _(t: Tables) -> DataFrame:
    return interpolate.idw(_values(t), _cells(t), nmax=3, maxdist=120)


_NEAR = {"vals": "select station, lon, lat from station"} | _cells_sql(_PICK) | {
    "d": f"select i, j, x, y, station, {KM} as km from vals cross join inside"}


@query("knn_stations", sql(
    f"select i, j, {r('x')} as x, {r('y')} as y, station, {r('km')} as km, rn as rank from (select *, row_number() over "
    "(partition by i, j order by km, station) as rn from d) q where rn <= 4", "station", "zone", "ints", extra=_NEAR))
def _(t: Tables) -> DataFrame:
    return interpolate.knn_stations(t.station.select("station", "lon", "lat"), _cells(t), 4)


@query("topk_nearest", sql(
    "select i, j, station from (select *, row_number() over (partition by i, j order by km, station) as rn from d) q "
    "where rn = 1", "station", "zone", "ints", extra=_NEAR))
def _(t: Tables) -> DataFrame:
    return interpolate.knn_stations(t.station.select("station", "lon", "lat"), _cells(t), 1).select("i", "j", "station")


@query("stations_within_distance", sql(
    f"select i, j, {r('x')} as x, {r('y')} as y, station, {r('km')} as km from d where km <= 150", "station", "zone", "ints",
    extra=_NEAR))
def _(t: Tables) -> DataFrame:
    return interpolate.stations_within_distance(t.station.select("station", "lon", "lat"), _cells(t), 150.0)


@query("idw_zonal", sql(
    f"select {stamp('date')} as date, zone_id, {r('avg(z)')} as value from (select date, i, j, zone_id, "
    f"coalesce(max(case when km < 1e-9 then value end), sum(value / pow(greatest(km, 1e-9), 2)) / "
    "sum(1 / pow(greatest(km, 1e-9), 2))) as z from d group by 1, 2, 3, 4) q group by date, zone_id",
    "obs", "station", "zone", "ints", extra=_cells_sql(_PICK) | {
        "vals": VALUES_SQL, "d": f"select date, i, j, zone_id, value, {KM} as km from vals cross join inside"}))
def _(t: Tables) -> DataFrame:
    return interpolate.idw_zonal(_values(t), _cells(t), t.zone)


@query("zonal_mean", sql(
    f"select zone_id, {r('avg(lon + lat)')} as value from station join zone on lon >= x0 and lon < x1 and lat >= y0 and lat < y1 "
    "group by 1", "station", "zone"))
def _(t: Tables) -> DataFrame:
    placed = zones.point_in_zone(t.station, t.zone, ["station"])
    return zones.zonal_mean(placed.withColumn("value", F.col("lon") + F.col("lat")), [])


@query("value_domain", sql(f"select {r('min(value)')} as low, {r('max(value)')} as high from vals",
                           "obs", "station", extra={"vals": VALUES_SQL}))
def _(t: Tables) -> DataFrame:
    return interpolate.value_domain(_values(t), "value")


@query("value_class", sql(
    f"select station, {stamp('date')} as date, least(6, floor((value - lo) / ((hi - lo) / 6e0)) + 1)::bigint as class from vals, "
    "(select min(value) as lo, max(value) as hi from vals) q", "obs", "station", extra={"vals": VALUES_SQL}))
def _(t: Tables) -> DataFrame:
    values = _values(t)
    domain = interpolate.value_domain(values, "value").select(F.struct("low", "high")).scalar()
    return values.withColumn("_d", domain).select(
        "station", "date", C.value_class("value", F.col("_d.low"), F.col("_d.high")).alias("class"))


# ---- imputation

CALENDAR = ("(floor((dayofyear(ts) - 1) / 7) + 1)::int as w, dayofweek(ts) + 1 as d, hour(ts) + 1 as h")


def decomposition_views(source: str, by: str = "pollutant") -> dict[str, str]:
    """Peer mean and effects as common table expressions; ``by`` lists the grouping columns."""
    keys = [k.strip() for k in by.split(",")]
    match = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in keys)

    def overall(name: str) -> str:
        return (f"select {by}, {name}, avg(m) as g from (select {by}, station, {name}, avg(x) as m from f group by all) a "
                "group by all")
    return {
        "f": f"select *, {CALENDAR} from {source}",
        "e": "select *, " + ", ".join(
            f"avg(x) over (partition by station, {by}, {n}) as m{n}" for n in "wdh")
             + f", sum(x) over (partition by {by}, w, d, h) as sx, count(x) over (partition by {by}, w, d, h) as nx from f",
        "bw": overall("w"), "bd": overall("d"), "bh": overall("h"),
        "dec": "select e.*, (sx - coalesce(x, 0e0)) / nullif(nx - case when x is null then 0 else 1 end, 0) as peer_mean, "
               "coalesce(mw - bw.g, 0e0) as ew, coalesce(md - bd.g, 0e0) as ed, coalesce(mh - bh.g, 0e0) as eh from e "
               f"left join bw on {match('bw', 'e')} and bw.w = e.w left join bd on {match('bd', 'e')} and bd.d = e.d "
               f"left join bh on {match('bh', 'e')} and bh.h = e.h",
    }


FIXED = "peer_mean + 0.5e0 * ew + 0.5e0 * ed + 0.5e0 * eh"


def moment_sql(regressors: list[str], target: str) -> str:
    """Sums of cross products, upper triangle, and of products with the target."""
    p = len(regressors)
    sums = [f"sum({regressors[i]} * {regressors[j]}) as a{i}{j}" for i in range(p) for j in range(i, p)]
    return ", ".join(sums + [f"sum({x} * {target}) as b{i}" for i, x in enumerate(regressors)])


def solve_views(by: str, p: int) -> dict[str, str]:
    """Solve the sums in view s0 per key: one elimination step per view, then back substitution into k0."""
    views = {}
    for k in range(p - 1):
        made = [by]
        for i in range(p):
            for j in range(i, p):
                made.append(f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} as a{i}{j}" if i > k else f"a{i}{j}")
            made.append(f"b{i} - a{k}{i} * b{k} / a{k}{k} as b{i}" if i > k else f"b{i}")
        views[f"s{k + 1}"] = f"select {', '.join(made)} from s{k}"
    source = f"s{p - 1}"
    for k in range(p - 1, -1, -1):
        rest = "".join(f" - a{k}{j} * c{j}" for j in range(k + 1, p))
        views[f"k{k}"] = f"select *, (b{k}{rest}) / a{k}{k} as c{k} from {source}"
        source = f"k{k}"
    return views


def weight_views(by: str) -> dict[str, str]:
    """Four-regressor least squares per key."""
    sums = moment_sql(["peer_mean", "ew", "ed", "eh"], "x")
    return {"s0": f"select {by}, {sums} from dec where x is not null and peer_mean is not null group by all"} | solve_views(by, 4)


def filled(estimate: str) -> str:
    return f"coalesce(x, case when {estimate} <= 0 then 0.01e0 else {estimate} end)"


WEIGHTED = "c0 * peer_mean + c1 * ew + c2 * ed + c3 * eh"


def _join(by: str) -> str:
    return " and ".join(f"k0.{k.strip()} = dec.{k.strip()}" for k in by.split(","))


@query("peer_mean", sql(
    f"select station, pollutant, {stamp('ts')} as ts, {r('x')} as x, {r('peer_mean')} as peer_mean from dec", "panel",
    extra=decomposition_views("panel")))
def _(t: Tables) -> DataFrame:
    return effects.peer_mean(t.panel)


@query("sdem", sql(
    f"select station, pollutant, {stamp('ts')} as ts, {r(filled(FIXED))} as x from dec", "panel",
    extra=decomposition_views("panel")))
def _(t: Tables) -> DataFrame:
    return effects.sdem(t.panel)


@query("sdem_global_weights", sql(
    f"select station, dec.pollutant, {stamp('ts')} as ts, {r(filled(WEIGHTED))} as x from dec left join k0 on {_join('pollutant')}",
    "panel", extra=decomposition_views("panel") | weight_views("pollutant")))
def _(t: Tables) -> DataFrame:
    return effects.sdem_global_weights(t.panel)


@query("sdem_station_weights", sql(
    f"select dec.station, dec.pollutant, {stamp('ts')} as ts, {r(filled(WEIGHTED))} as x from dec "
    f"left join k0 on {_join('pollutant, station')}", "panel",
    extra=decomposition_views("panel") | weight_views("pollutant, station")))
def _(t: Tables) -> DataFrame:
    return effects.sdem_station_weights(t.panel)


@query("impute_warmup", sql(
    f"select station, pollutant, {stamp('ts')} as ts, case when ts < (select min(ts) from panel) + interval 6 hour then "
    f"{r(filled(FIXED))} else {r('x')} end as x from dec", "panel", extra=decomposition_views("panel")))
def _(t: Tables) -> DataFrame:
    return effects.warm_up(t.panel)


@query("impute_all_pollutants", sql(
    f"select station, {stamp('ts')} as begin_ts, " + ", ".join(
        r(f"max(case when pollutant = '{p}' then {filled(FIXED)} end)") + f' as "{p}"' for p in PARTS)
    + " from dec group by station, ts", "panel", extra=decomposition_views("panel")))
def _(t: Tables) -> DataFrame:
    from stationweave.plans.workflows import impute
    wide = aggregate.pivot_wider(t.panel, ["station", "ts"], "pollutant", POLLUTANTS, F.max("x"))
    table = wide.withColumnRenamed("ts", "begin_ts").withColumn("averaging_time", F.lit("hour"))
    return impute(table).select("station", "begin_ts", *POLLUTANTS)


# ---- gap injection and scoring

SEED, SCENARIOS = 77, 3


def uniform_sql(index: str, stream: int) -> str:
    return f"(('0x' || left(md5(concat_ws(':', '{SEED}', '{stream}', cast({index} as varchar))), 13))::bigint / 4503599627370496e0)"


def _class_sql(at: int) -> str:
    total, whens = 0.0, []
    for entry in evaluation.GAP_CLASSES[:-1]:
        total += entry[1]
        whens.append(f"when u1 < {total!r}e0 then {entry[at]}")
    return "case " + " ".join(whens) + f" else {evaluation.GAP_CLASSES[-1][at]} end"


MASK = {
    "size": "select (select count(distinct station) from panel) as ns, min(ts) as t0, "
            "((epoch(max(ts)) - epoch(min(ts))) / 3600)::bigint + 1 as nh from panel",
    "per": "select *, greatest(ceil(ns * nh * 435 / 23064e0), 1)::bigint as n from size",
    "ids": f"select *, unnest(generate_series(0, n * {SCENARIOS} - 1)) as id from per",
    "u1": f"select *, id // n as scenario, id % n as gap, {uniform_sql('id', 0)} as u1, {uniform_sql('id', 1)} as u2, "
          f"{uniform_sql('id', 2)} as u3 from ids",
    "len": f"select *, {_class_sql(2)} as lo, {_class_sql(3)} as hi from u1",
    "gaps": "select *, (lo + floor(u2 * (hi - lo + 1)))::bigint as length from len",
    "spot": "select *, greatest(nh - length + 1, 1) as room, floor(u3 * (ns * greatest(nh - length + 1, 1)))::bigint as pos from gaps",
    "idx": "select station, row_number() over (order by station) - 1 as k from (select distinct station from panel) q",
    "mask": "select distinct scenario, station, t0 + to_hours(h) as ts from (select *, unnest(generate_series(pos % room, "
            "least(pos % room + length, nh) - 1)) as h from spot) s join idx on idx.k = s.pos // s.room",
}


@query("inject_gaps", sql(f"select scenario, station, {stamp('ts')} as ts from mask", "panel", extra=MASK))
def _(t: Tables) -> DataFrame:
    return evaluation.inject_gaps(t.panel_obs, SCENARIOS, SEED)


@query("longest_first", sql("select scenario, gap, length from gaps", "panel", extra=MASK))
def _(t: Tables) -> DataFrame:
    observed = t.panel_obs
    size = observed.select("station").distinct().agg(F.count(F.lit(1)).alias("_stations"))
    hours = observed.agg(F.date_trunc("day", F.min("ts")).alias("a"), F.date_trunc("day", F.max("ts")).alias("b")).select(
        ((F.unix_timestamp("b") - F.unix_timestamp("a")) / 3600 + 24).cast("long")).scalar()
    frame = size.withColumn("_hours", hours)
    gaps = evaluation.draw_gaps(F.col("_stations") * F.col("_hours"), SCENARIOS, frame, SEED)
    return evaluation.longest_first(gaps).select("scenario", "gap", "length")


MASKED = MASK | {
    "spread": f"select p.*, s.scenario from panel p cross join (select unnest(generate_series(0, {SCENARIOS - 1})) as scenario) s",
    "blank": "select s.scenario, s.station, s.pollutant, s.ts, case when m.station is not null then s.x end as truth, "
             "case when m.station is null then s.x end as x from spread s left join mask m on m.scenario = s.scenario "
             "and m.station = s.station and m.ts = s.ts",
}
SCORES = (f"count(*)::bigint as n, {r('1 - sum(pow(truth - est, 2)) / nullif(var_pop(truth) * count(*), 0)')} as r2, "
          f"{r('sqrt(avg(pow(truth - est, 2)))')} as rmse, {r('avg(abs(truth - est))')} as mae")
METHOD_VIEWS = MASKED | decomposition_views("blank", "scenario, pollutant")


def renamed(views: dict[str, str], prefix: str) -> dict[str, str]:
    """Solving views under names of their own."""
    return {prefix + n: re.sub(r"\b([sk]\d)\b", prefix + r"\1", t) for n, t in views.items()}


def _clipped(estimate: str) -> str:
    return f"case when {estimate} <= 0 then 0.01e0 else {estimate} end"


METHOD_VIEWS |= renamed(weight_views("scenario, pollutant"), "g") | renamed(weight_views("scenario, pollutant, station"), "o") | {
    "estimated": " union all ".join([
        f"select 'sdem' as method, scenario, pollutant, truth, {_clipped(FIXED)} as est from dec",
        f"select 'sdem_global_weights', dec.scenario, dec.pollutant, truth, {_clipped(WEIGHTED)} from dec join gk0 "
        "on gk0.scenario = dec.scenario and gk0.pollutant = dec.pollutant",
        f"select 'sdem_station_weights', dec.scenario, dec.pollutant, truth, {_clipped(WEIGHTED)} from dec join ok0 "
        "on ok0.scenario = dec.scenario and ok0.pollutant = dec.pollutant and ok0.station = dec.station"]),
    "judged": "select * from estimated where truth is not null and est is not null",
}


@query("evaluate_imputation", sql(f"select method, scenario, pollutant, {SCORES} from judged group by all", "panel", extra=METHOD_VIEWS,
                                  kept=True))
def _(t: Tables) -> DataFrame:
    ensure_checkpoint_dir(t.spark)
    mask = evaluation.inject_gaps(t.panel_obs, SCENARIOS, SEED).checkpoint()
    return evaluation.evaluate_imputation(t.panel, mask, SCENARIOS)


_RAW_SCORED = {"scored": "select method, scenario, count(*) as n, 1 - sum(pow(truth - est, 2)) / nullif(var_pop(truth) * count(*), 0) "
               "as r2, sqrt(avg(pow(truth - est, 2))) as rmse, avg(abs(truth - est)) as mae from judged group by all"}


@query("score_summary", sql(
    f"select method, {r('avg(r2)')} as r2_mean, {r('avg(rmse)')} as rmse_mean, {r('stddev_samp(rmse)')} as rmse_sd, "
    f"{r('avg(mae)')} as mae_mean, {r('stddev_samp(mae)')} as mae_sd, {r('avg(n)')} as n_mean from scored group by method", "panel",
    extra=METHOD_VIEWS | _RAW_SCORED, kept=True))
def _(t: Tables) -> DataFrame:
    ensure_checkpoint_dir(t.spark)
    mask = evaluation.inject_gaps(t.panel_obs, SCENARIOS, SEED).checkpoint()
    estimates = evaluation.imputation_estimates(t.panel, mask, SCENARIOS)
    return evaluation.score_summary(evaluation.score(estimates, ["method", "scenario"]))


def _score(name: str, expression: str) -> None:
    @query(f"score_{name}", sql(
        f"select pollutant, {r(expression)} as {name} from (select a.pollutant, a.x as truth, b.x as est from panel a "
        "join panel b on b.station = a.station and b.pollutant = a.pollutant and b.ts = a.ts + interval 1 hour "
        "where a.x is not null and b.x is not null) q group by 1", "panel"))
    def _(t: Tables) -> DataFrame:
        ahead = panel.add_leads(t.panel, "x", leads=(1,))
        return evaluation.score(ahead, ["pollutant"], "x", "x_lead1").select("pollutant", name)


_score("r2", "1 - sum(pow(truth - est, 2)) / nullif(var_pop(truth) * count(*), 0)")
_score("rmse", "sqrt(avg(pow(truth - est, 2)))")
_score("mae", "avg(abs(truth - est))")
