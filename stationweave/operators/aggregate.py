"""Reshaping and calendar aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stationweave.functions.columns import LOCAL_ZONE, local_time, period_start
from stationweave.functions.quantiles import MAX_DISTINCT, grouped_quantiles
from stationweave.functions.statistics import check_names, moment, order_probability

MEASUREMENT_KEY = ("station", "averaging_time", "begin_ts", "end_ts")


def strict_mean(value: Column, present: Column | None = None) -> Column:
    """Mean that is NULL as soon as one of the rows is NULL. ``present`` marks the rows that take part."""
    rows = F.count(F.lit(1)) if present is None else F.count_if(present)
    return F.when((rows > 0) & (rows == F.count(value)), F.avg(value))


def pivot_measurements(df: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """Long to wide, one column per pollutant; duplicates are averaged and one NULL duplicate makes NULL.

    Written as one conditional aggregation, so duplicates combine map-side and the table is shuffled once.
    """
    columns = []
    for p in pollutants:
        mine = F.col("pollutant") == p
        columns.append(strict_mean(F.when(mine, F.col("concentration")), mine).alias(p))
    return df.groupBy(*[c for c in MEASUREMENT_KEY if c in df.columns]).agg(*columns)


def pivot_longer(df: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """Wide to long."""
    rest = [c for c in df.columns if c not in set(pollutants)]
    return df.unpivot(rest, list(pollutants), "pollutant", "concentration")


def pivot_wider(df: DataFrame, keys: Sequence[str], names: str, wanted: Sequence[str], aggregate: Column) -> DataFrame:
    """General long to wide with an explicit column list and a caller-chosen aggregate."""
    return df.groupBy(*keys).pivot(names, list(wanted)).agg(aggregate)


def deduplicate(df: DataFrame) -> DataFrame:
    """Long table with one row per measurement key and pollutant, by the pivot's averaging rule."""
    keys = [c for c in MEASUREMENT_KEY if c in df.columns]
    return df.groupBy(*keys, "pollutant").agg(strict_mean(F.col("concentration")).alias("concentration"))


def time_aggregate(
    df: DataFrame,
    frequency: str = "monthly",
    functions: Sequence[str] = ("mean", "min", "max"),
    zone: str = LOCAL_ZONE,
    max_distinct: int = MAX_DISTINCT,
) -> DataFrame:
    """Statistics per station, pollutant and local calendar period; one column per function, NULLs skipped.

    Moments of every pollutant come from one aggregation. Order statistics are added by an exact distributed
    selection, only when asked for.
    """
    names = list(functions)
    check_names(names)
    keys = [c for c in ("station", "station_name", "pollutant") if c in df.columns] + ["date"]
    rows = (df.withColumn("date", period_start(local_time("begin_ts", zone), frequency))
            .select(*keys, "concentration"))
    return grouped_statistics(rows, keys, "concentration", names, max_distinct)


def grouped_statistics(
    rows: DataFrame, keys: Sequence[str], value: str, names: Sequence[str], max_distinct: int = MAX_DISTINCT,
) -> DataFrame:
    """One column per named statistic for every group, in the order of ``names``."""
    keys = list(keys)
    ordered = {n: p for n in names if (p := order_probability(n)) is not None}
    plain = [n for n in names if n not in ordered]
    out = rows.groupBy(*keys).agg(*[moment(n, F.col(value)).alias(n) for n in plain]) if plain else (
        rows.select(*keys).distinct())
    if ordered:
        found = grouped_quantiles(rows, keys, value, list(ordered.values()), max_distinct)
        picked = [F.col("quantiles")[i].alias(n) for i, n in enumerate(ordered)]
        out = out.join(found.select(*keys, *picked), keys, "left")
    return out.select(*keys, *[F.col(f"`{n}`") for n in names])


def time_aggregate_wide(aggregate: DataFrame, pollutants: Sequence[str], functions: Sequence[str]) -> DataFrame:
    """Columns ``<pollutant>_<function>`` from the long aggregate, or just ``<function>`` for one pollutant."""
    keys = [c for c in ("station", "station_name", "date") if c in aggregate.columns]
    if len(pollutants) == 1:
        return aggregate.where(F.col("pollutant") == pollutants[0]).drop("pollutant")
    columns = [F.max(F.when(F.col("pollutant") == p, F.col(f"`{f}`"))).alias(f"{p}_{f}")
               for p in pollutants for f in functions]
    return aggregate.groupBy(*keys).agg(*columns)


def time_aggregate_by_pollutant(aggregate: DataFrame, pollutants: Sequence[str]) -> dict[str, DataFrame]:
    """One lazy table per pollutant."""
    return {p: aggregate.where(F.col("pollutant") == p).drop("pollutant") for p in pollutants}


def sort_station_time(df: DataFrame) -> DataFrame:
    return df.orderBy("station", "begin_ts")
