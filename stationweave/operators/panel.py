"""Complete hourly panels, carry-forward and model features."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions.columns import time_of_week
from stationweave.functions.sequences import CHUNK_HOURS, nearest_observed, shifted
from stationweave.session import shuffle_width

# Row offsets of the model features.
LAGS = (1, 2, 3, 4, 5)
LONG_LAGS = (1, 24, 168)
LEADS = (1, 2, 3)


def hourly_panel(observed: DataFrame, pollutants: DataFrame | None = None) -> DataFrame:
    """Every station x pollutant x hour between the first and the last day, with the observed value or NULL.

    ``observed`` has one row per (station, pollutant, ts). The frame is exploded from the station list; the pollutant
    list and the time range are single-row subqueries, so nothing is cross joined.
    """
    span = observed.agg(F.date_trunc("day", F.min("ts")).alias("a"),
                        (F.date_trunc("day", F.max("ts")) + F.expr("interval 23 hours")).alias("b"))
    names = (pollutants or observed).select("pollutant").distinct().agg(F.collect_list("pollutant")).scalar()
    hours = span.select(F.sequence("a", "b", F.expr("interval 1 hour"))).scalar()
    # The station list is tiny, so it is spread out before it grows into hours. Its size says nothing about the frame's, and
    # where only observed cells are asked for the join is an inner one: left to that size, the frame would be broadcast.
    frame = (observed.select("station").distinct()
             .withColumn("pollutant", F.explode(names))
             .repartition(shuffle_width(observed.sparkSession), "station", "pollutant")
             .withColumn("ts", F.explode(hours)))
    return frame.hint("merge").join(observed, ["station", "pollutant", "ts"], "left")


def locf(
    df: DataFrame, keys: Sequence[str] = ("station", "pollutant"), ts: str = "ts", value: str = "x",
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Last observation carried forward; leading gaps take the next observation."""
    near = nearest_observed(df, keys, ts, value, "_prev", "_next", chunk_hours)
    return near.withColumn(value, F.coalesce(value, "_prev", "_next")).drop("_prev", "_next")


def feature_shifts(target: str, covariates: Sequence[str], lags: Sequence[int] = LAGS,
                   leads: Sequence[int] = LEADS, covariate_lags: Sequence[int] | None = None) -> dict:
    """Named offsets: ``<column>_lag<k>`` and ``<column>_lead<k>``."""
    wanted: dict[str, tuple[str, int]] = {}
    for column in (target, *covariates):
        back = lags if column == target or covariate_lags is None else covariate_lags
        wanted.update({f"{column}_lag{k}": (column, -k) for k in back})
        wanted.update({f"{column}_lead{k}": (column, k) for k in leads})
    return wanted


def add_lags(df: DataFrame, column: str, keys: Sequence[str] = ("station", "pollutant"), ts: str = "ts",
             lags: Sequence[int] = LAGS) -> DataFrame:
    return shifted(df, keys, ts, {f"{column}_lag{k}": (column, -k) for k in lags})


def add_leads(df: DataFrame, column: str, keys: Sequence[str] = ("station", "pollutant"), ts: str = "ts",
              leads: Sequence[int] = LEADS) -> DataFrame:
    return shifted(df, keys, ts, {f"{column}_lead{k}": (column, k) for k in leads})


def panel_features(
    wide: DataFrame, target: str, covariates: Sequence[str], keys: Sequence[str] = ("station",), ts: str = "ts",
    lags: Sequence[int] = LAGS, leads: Sequence[int] = LEADS, chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Lags and leads of the target and its covariates plus the hour of the week, in one window pass."""
    shifts = feature_shifts(target, covariates, lags, leads)
    return shifted(wide, keys, ts, shifts, chunk_hours).withColumn("time", time_of_week(ts))


def filter_complete_lags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns))


def training_window(df: DataFrame, day: str, hours: int = 168, ts: str = "ts") -> DataFrame:
    """Rows of the trailing ``hours`` before the first instant of ``day``."""
    stop = F.lit(day).cast("timestamp")
    return df.where((F.col(ts) >= stop - F.make_dt_interval(hours=F.lit(hours))) & (F.col(ts) < stop))


def distinct_hours_sorted(df: DataFrame, value: str = "x", ts: str = "ts") -> DataFrame:
    """Hours that still need a value, ascending."""
    return df.where(F.col(value).isNull()).select(ts).distinct().orderBy(ts)
