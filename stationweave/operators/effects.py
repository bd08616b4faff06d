"""Station-effects decomposition: estimate = peer mean + weighted week, weekday and hour effects."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions.columns import clip_floor, hour_slot, week_of_year, weekday
from stationweave.functions.linalg import grouped_moments, linear_predictor, solve_moments

# Weights of peer mean, week, weekday and hour effect.
WEIGHTS = (1.0, 0.5, 0.5, 0.5)
KINDS = ("week", "weekday", "hour")
REGRESSORS = ("peer_mean", "week_effect", "weekday_effect", "hour_effect")
GROUP = ("pollutant",)


def with_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns({"week": week_of_year(ts), "weekday": weekday(ts), "hour": hour_slot(ts)})


def bucket_effects(panel: DataFrame, value: str = "x", ts: str = "ts", group: Sequence[str] = GROUP) -> DataFrame:
    """(group, station, kind, bucket, effect): station mean in the bucket minus the mean of all stations' means.

    All three bucketings share one map-side-combined aggregation.
    """
    group = list(group)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("int").alias("bucket")) for k in KINDS])
    own = (with_calendar(panel, ts).where(F.col(value).isNotNull())
           .select(*group, "station", value, F.explode(kinds).alias("_k"))
           .groupBy(*group, "station", "_k.kind", "_k.bucket").agg(F.avg(value).alias("_mean")))
    overall = own.groupBy(*group, "kind", "bucket").agg(F.avg("_mean").alias("_overall"))
    return (own.join(overall, [*group, "kind", "bucket"])
            .select(*group, "station", "kind", "bucket", (F.col("_mean") - F.col("_overall")).alias("effect")))


def peer_mean(panel: DataFrame, value: str = "x", ts: str = "ts", group: Sequence[str] = GROUP) -> DataFrame:
    """Add ``peer_mean``: mean of the other stations' values in the same week, weekday and hour.

    Leave-one-out from bucket sums: the sums are aggregated map-side and joined back, so a crowded bucket is never
    one task's window partition.
    """
    return _with_peers(with_calendar(panel, ts), value, list(group)).drop(*KINDS)


def _with_peers(panel: DataFrame, value: str, group: list[str]) -> DataFrame:
    keys = [*group, *KINDS]
    sums = panel.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    mine = F.when(F.col(value).isNotNull(), 1).otherwise(0)
    rest = F.try_divide(F.col("_sum") - F.coalesce(value, F.lit(0.0)), F.col("_count") - mine)
    return panel.join(sums, keys, "left").withColumn("peer_mean", rest).drop("_sum", "_count")


def decomposition(
    panel: DataFrame, value: str = "x", ts: str = "ts", group: Sequence[str] = GROUP, nan_as_zero: bool = True,
) -> DataFrame:
    """Panel rows with peer mean and the three effects.

    The effects of one station are at most 53 + 7 + 24 numbers, packed in a map, so the panel needs one join for
    all of them. A missing own effect counts as 0; with ``nan_as_zero=False`` it stays NULL.
    """
    group = list(group)
    effects = bucket_effects(panel, value, ts, group)
    entry = F.struct(F.concat_ws(":", "kind", "bucket"), F.col("effect"))
    packed = effects.groupBy(*group, "station").agg(F.map_from_entries(F.collect_list(entry)).alias("_effects"))
    rows = with_calendar(panel, ts).join(packed, [*group, "station"], "left")
    for kind in KINDS:
        found = F.try_element_at("_effects", F.concat(F.lit(f"{kind}:"), F.col(kind).cast("string")))
        rows = rows.withColumn(f"{kind}_effect", F.coalesce(found, F.lit(0.0)) if nan_as_zero else found)
    return _with_peers(rows.drop("_effects"), value, group).drop(*KINDS)


def _filled(rows: DataFrame, value: str, estimate, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn(value, F.coalesce(F.col(value), clip_floor(estimate))).select(*columns)


def sdem(panel: DataFrame, value: str = "x", ts: str = "ts", group: Sequence[str] = GROUP,
         nan_as_zero: bool = True) -> DataFrame:
    """Fill NULL cells by the fixed-weight decomposition; a cell without any peer stays NULL."""
    rows = decomposition(panel, value, ts, group, nan_as_zero)
    estimate = F.col("peer_mean")
    for weight, name in zip(WEIGHTS[1:], REGRESSORS[1:], strict=True):
        estimate = estimate + F.lit(weight) * F.col(name)
    return _filled(rows, value, estimate, panel.columns)


def fitted_weights(rows: DataFrame, keys: Sequence[str], value: str = "x") -> DataFrame:
    """No-intercept least-squares weights of the four regressors per key, from rows with nothing missing."""
    sums = grouped_moments(rows, keys, [F.col(r) for r in REGRESSORS], F.col(value))
    return sums.select(*keys, solve_moments("moments").alias("weights"))


def _weighted(panel: DataFrame, value: str, ts: str, group: list[str], keys: list[str]) -> DataFrame:
    rows = decomposition(panel, value, ts, group)
    fitted = rows.join(fitted_weights(rows, keys, value), keys, "left")
    estimate = linear_predictor(F.col("weights"), [F.col(r) for r in REGRESSORS])
    return _filled(fitted, value, estimate, panel.columns)


def sdem_global_weights(panel: DataFrame, value: str = "x", ts: str = "ts",
                        group: Sequence[str] = GROUP) -> DataFrame:
    """Decomposition with weights fitted over all stations of a group (one fit per pollutant)."""
    return _weighted(panel, value, ts, list(group), list(group))


def sdem_station_weights(panel: DataFrame, value: str = "x", ts: str = "ts",
                         group: Sequence[str] = GROUP) -> DataFrame:
    """Decomposition with weights fitted per station."""
    return _weighted(panel, value, ts, list(group), [*group, "station"])


METHODS = {"sdem": sdem, "sdem_global_weights": sdem_global_weights, "sdem_station_weights": sdem_station_weights}


def warm_up(panel: DataFrame, hours: int = 6, value: str = "x", ts: str = "ts",
            group: Sequence[str] = GROUP) -> DataFrame:
    """Fill only the first hours of the panel by the fixed-weight decomposition."""
    start = panel.agg(F.min(ts)).scalar()
    early = F.col(ts) < start + F.make_dt_interval(hours=F.lit(hours))
    filled = sdem(panel.withColumn("_raw", F.col(value)), value, ts, group)
    return filled.withColumn(value, F.when(early, F.col(value)).otherwise(F.col("_raw"))).select(*panel.columns)
