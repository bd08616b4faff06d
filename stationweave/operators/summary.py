"""Quality summaries: counters, per-pollutant and per-station tables, gaps, correlations."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stationweave.functions.columns import hours_between, nan_inf_to_null
from stationweave.functions.sequences import CHUNK_HOURS, chunk_of
from stationweave.operators.aggregate import pivot_longer
from stationweave.operators.stations import stations_info


def dataset_counters(df: DataFrame) -> DataFrame:
    """One row: rows, distinct stations, distinct timestamps, first and last time.

    Each distinct count first reduces to one row per value, so neither becomes a single-task set.
    """
    base = df.agg(F.count(F.lit(1)).alias("rows"), F.min("begin_ts").alias("first_ts"),
                  F.max("begin_ts").alias("last_ts"))
    stations = df.select("station").distinct().agg(F.count(F.lit(1))).scalar()
    times = df.select("begin_ts").distinct().agg(F.count(F.lit(1))).scalar()
    return base.select("rows", stations.alias("stations"), times.alias("timestamps"), "first_ts", "last_ts")


def _long(wide: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    keep = [c for c in ("station", "averaging_time", "begin_ts") if c in wide.columns]
    return pivot_longer(wide.select(*keep, *pollutants), pollutants)


def summary_global(wide: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """Per pollutant: missing count and share, negatives, min over non-negative values, mean, max, sd."""
    x = F.col("concentration")
    return _long(wide, pollutants).groupBy("pollutant").agg(
        F.count_if(x.isNull()).alias("na_count"),
        (F.count_if(x.isNull()) * 100.0 / F.count(F.lit(1))).alias("na_perc"),
        F.count_if(x < 0).alias("negative"),
        F.min(F.when(x >= 0, x)).alias("min"),
        nan_inf_to_null(F.avg(x)).alias("mean"),
        F.max(x).alias("max"),
        nan_inf_to_null(F.stddev_samp(x)).alias("sd"))


def summary_by_station(wide: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """All per-station statistics in one aggregation; the minimum includes negatives."""
    x = F.col("concentration")
    return _long(wide, pollutants).groupBy("station", "pollutant").agg(
        F.count_if(x.isNull()).alias("na_count"),
        (F.count_if(x.isNull()) * 100.0 / F.count(F.lit(1))).alias("na_perc"),
        F.count_if(x < 0).alias("negative"),
        nan_inf_to_null(F.min(x)).alias("min"),
        nan_inf_to_null(F.avg(x)).alias("mean"),
        nan_inf_to_null(F.max(x)).alias("max"),
        nan_inf_to_null(F.stddev_samp(x)).alias("sd"))


def summary_statistic(wide: DataFrame, pollutants: Sequence[str], statistic: str) -> DataFrame:
    """One of the per-station tables; Catalyst drops the aggregates that are not kept."""
    return summary_by_station(wide, pollutants).select("station", "pollutant", statistic)


def summary_averaging_time(wide: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """Averaging times with at least one value per station and pollutant, sorted and joined by ", "."""
    seen = (_long(wide, pollutants).where(F.col("concentration").isNotNull())
            .select("station", "pollutant", "averaging_time").distinct())
    return seen.groupBy("station", "pollutant").agg(
        F.array_join(F.array_sort(F.collect_list("averaging_time")), ", ").alias("averaging_times"))


def observation_gaps(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Hours from every observed row to the next one; a group's first and last row count as observed.

    Only observed rows and the two ends of each group move. Inside a calendar chunk the next row is a window lead; the
    last row of a chunk takes the first row of the next non-empty chunk from a table with one row per chunk.
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.array(F.min(ts), F.max(ts)).alias("_ends")).select(*keys, F.explode("_ends").alias(ts))
    observed = (df.where(F.col(value).isNotNull()).select(*keys, ts).unionByName(ends)
                .withColumn("_chunk", chunk_of(F.col(ts), chunk_hours)))
    chunks = observed.groupBy(*keys, "_chunk").agg(F.min(ts).alias("_first"))
    following = chunks.select(
        *keys, "_chunk", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_after"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    # An observed end appears twice; the copy that leads to itself goes.
    return (observed.join(following, [*keys, "_chunk"])
            .withColumn("next_ts", F.coalesce(F.lead(ts).over(inner), F.col("_after")))
            .where(F.col("next_ts").isNull() | (F.col("next_ts") > F.col(ts)))
            .select(*keys, ts, "next_ts", hours_between(F.col(ts), F.col("next_ts")).alias("gap_hours")))


def gap_length(
    df: DataFrame, keys: Sequence[str] = ("station", "pollutant"), ts: str = "ts", value: str = "x",
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Distribution of the positive gaps per group.

    Everything follows from one table of gap lengths and their counts. The gaps of a group are whole seconds and add up
    to its time span, so few of them differ (under 80 000 in a century) and one aggregate holds the exact quartiles.
    """
    keys = list(keys)
    gaps = observation_gaps(df, keys, ts, value, chunk_hours).where(F.col("gap_hours") > 0)
    counted = gaps.groupBy(*keys, "gap_hours").agg(F.count(F.lit(1)).alias("_c"))
    g, c = F.col("gap_hours"), F.col("_c")
    n, total, square = F.sum(c), F.sum(c * g), F.sum(c * g * g)
    spread = F.sqrt(F.greatest(F.try_divide(square - total * total / n, n - 1), F.lit(0.0)))
    quartiles = F.percentile(g, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), c)
    q = F.col("quartiles")
    return counted.groupBy(*keys).agg(
        F.min(g).alias("min_gap"), F.round(total / n, 3).alias("mean_gap"), F.max(g).alias("max_gap"),
        F.round(F.when(n > 1, spread), 3).alias("sd_gap"), quartiles.alias("quartiles")).select(
        *keys, "min_gap", q[0].alias("q25_gap"), "mean_gap", q[1].alias("median_gap"),
        q[2].alias("q75_gap"), "max_gap", "sd_gap")


def corr_matrix(wide: DataFrame, pollutants: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every ordered pollutant pair per station; NULL without variance.

    All pairs come from one map-side-combined aggregation over the wide row: no self join.
    """
    names = list(pollutants)
    sums = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            sums.append(nan_inf_to_null(r).alias(f"_{i}_{names.index(b)}"))
    own = [F.when(F.var_pop(a) > 0, 1.0).alias(f"_{i}_{i}") for i, a in enumerate(names)]
    table = wide.groupBy("station").agg(*sums, *own)
    entries = [F.struct(F.lit(a).alias("pollutant_1"), F.lit(b).alias("pollutant_2"),
                        F.col(f"_{min(i, j)}_{max(i, j)}").alias("correlation"))
               for i, a in enumerate(names) for j, b in enumerate(names)]
    return table.select("station", F.explode(F.array(*entries)).alias("_e")).select("station", "_e.*")


def summary(wide: DataFrame, pollutants: Sequence[str], master: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every summary table, each a lazy DataFrame; with the station ``master`` also what it says of the stations at hand."""
    long = pivot_longer(wide, pollutants)
    tables = {
        "counters": dataset_counters(wide),
        "summary": summary_global(wide, pollutants),
        "by_station": summary_by_station(wide, pollutants),
        "averaging_time": summary_averaging_time(wide, pollutants),
        "gap_length": gap_length(long, ts="begin_ts", value="concentration"),
    }
    if master is not None:
        tables["stations"] = stations_info(wide, master, pollutants)
    if len(pollutants) > 1:
        tables["corr_matrix"] = corr_matrix(wide, pollutants)
    return tables
