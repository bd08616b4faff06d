"""Gap injection, scoring and comparison of imputation methods. A scenario is a key column, never a loop."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stationweave.functions.columns import clip_floor, hour_index
from stationweave.functions.linalg import grouped_moments, linear_predictor, solve_moments
from stationweave.functions.sequences import dense_index
from stationweave.operators import effects, recursion, regression, spatial_regression
from stationweave.operators.panel import panel_features
from stationweave.session import shuffle_width

# Gap classes as (name, probability, shortest, longest) in hours.
GAP_CLASSES = (
    ("one", 0.818, 1, 1),
    ("two", 0.0898, 2, 2),
    ("three", 0.0368, 3, 3),
    ("short", 0.0373, 4, 24),
    ("medium", 0.0148, 25, 72),
    ("long", 0.00314, 73, 120),
)
# Gaps per panel cell of the reference evaluation (435 gaps over 23 064 cells).
GAPS, PANEL_CELLS = 435, 23064
DRAWS_PER_TASK_ROW = 1000


def uniform(index: str, stream: int, seed: int) -> Column:
    """Reproducible number in [0, 1) per index: the first 52 bits of a digest, the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), F.col(index).cast("string")))
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("bigint") / F.lit(2.0 ** 52)


def _class_column(u: Column, pick: Callable[[tuple], Column]) -> Column:
    """Pick by cumulative probability; the last class takes what rounding leaves."""
    out = pick(GAP_CLASSES[-1])
    cumulative = 0.0
    limits = []
    for entry in GAP_CLASSES[:-1]:
        cumulative += entry[1]
        limits.append((cumulative, entry))
    for limit, entry in reversed(limits):
        out = F.when(u < limit, pick(entry)).otherwise(out)
    return out


def draw_gaps(cells: Column, scenarios: int, frame: DataFrame, seed: int) -> DataFrame:
    """(scenario, gap, length) drawn from the class distribution; ``frame`` is a one-row table giving ``cells``.

    The number of gaps keeps the reference share of the panel. Draws grow in two steps so that no task makes them all.
    """
    per = F.greatest(F.ceil(cells * GAPS / PANEL_CELLS), F.lit(1)).cast("long")
    step = DRAWS_PER_TASK_ROW
    counted = frame.withColumn("_n", per).withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))))
    starts = counted.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long"))))
    draws = (starts.repartition(shuffle_width(frame.sparkSession), "scenario", "_s")
             .withColumn("gap", F.explode(F.sequence("_s", F.least(F.col("_s") + step, F.col("_n")) - 1)))
             .withColumn("_id", F.col("scenario") * F.col("_n") + F.col("gap")))
    drawn = draws.withColumns({n: uniform("_id", k, seed) for k, n in enumerate(("_kind", "_size", "_where"))})
    low, high = (_class_column(F.col("_kind"), lambda e, at=at: F.lit(e[at])) for at in (2, 3))
    sized = drawn.withColumns({"_low": low, "_high": high})
    length = F.col("_low") + F.floor(F.col("_size") * (F.col("_high") - F.col("_low") + 1))
    return sized.select(*frame.columns, F.col("scenario").cast("long"), "gap", "_where",
                        length.cast("long").alias("length"))


def longest_first(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy("scenario", F.desc("length"), "gap")


def inject_gaps(observed: DataFrame, scenarios: int, seed: int, ts: str = "ts") -> DataFrame:
    """Mask (scenario, station, ts) over the complete hourly panel of ``observed`` (whole days, every station).

    A gap lies inside one station's hours; overlapping gaps merge, so the masked total varies. Only the station list
    and the time range are read, not the panel itself.
    """
    stations = observed.select("station").distinct()
    indexed = dense_index(stations, "station", "_index")
    span = observed.agg(F.date_trunc("day", F.min(ts)).alias("_from"), F.date_trunc("day", F.max(ts)).alias("_to"))
    hours = hour_index("_to") - hour_index("_from") + 24
    count = stations.agg(F.count(F.lit(1))).scalar()
    frame = span.select("_from", hours.alias("_hours")).withColumn("_stations", count)
    gaps = draw_gaps(F.col("_stations") * F.col("_hours"), scenarios, frame, seed)
    room = F.greatest(F.col("_hours") - F.col("length") + 1, F.lit(1))
    placed = gaps.withColumn("_room", room)
    placed = placed.withColumn("_position", F.floor(F.col("_where") * (F.col("_stations") * F.col("_room"))))
    placed = placed.withColumns({"_index": F.floor(F.col("_position") / F.col("_room")),
                                 "_start": F.pmod("_position", "_room")})
    last = F.least(F.col("_start") + F.col("length"), F.col("_hours")) - 1
    # Gaps grow out of one row, so the optimizer would take them for the smaller side.
    spread = placed.hint("merge").join(indexed, "_index").withColumn("_at", F.explode(F.sequence("_start", last)))
    stamp = F.timestamp_seconds(F.unix_timestamp("_from") + F.col("_at") * 3600)
    return spread.select("scenario", "station", stamp.alias(ts)).distinct()


def masked_panel(panel: DataFrame, mask: DataFrame, scenarios: int, value: str = "x", ts: str = "ts") -> DataFrame:
    """Panel once per scenario with the masked values blanked; ``truth`` keeps the value that was hidden."""
    spread = panel.withColumn(
        "scenario", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(scenarios - 1).cast("long"))))
    hit = spread.join(mask.withColumn("_hit", F.lit(True)), ["scenario", "station", ts], "left")
    hidden = F.col("_hit").isNotNull()
    return hit.withColumns({"truth": F.when(hidden, F.col(value)), value: F.when(~hidden, F.col(value))}).drop("_hit")


def score(pairs: DataFrame, keys: Sequence[str], truth: str = "truth", estimate: str = "estimate") -> DataFrame:
    """R2, RMSE and MAE per key over rows with both values; R2 is NULL without variance."""
    both = pairs.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull())
    error = F.col(truth) - F.col(estimate)
    tss = F.var_pop(truth) * F.count(F.lit(1))
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(F.sum(error * error), tss)).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"))


def score_summary(scores: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Mean of every score over the scenarios, spread of the errors and mean masked count."""
    return scores.groupBy(*keys).agg(
        F.avg("r2").alias("r2_mean"), F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_sd"),
        F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_sd"), F.avg("n").alias("n_mean"))


def masked_regressors(panel: DataFrame, mask: DataFrame, value: str = "x", ts: str = "ts",
                      group: Sequence[str] = effects.GROUP) -> DataFrame:
    """Peer mean and effects of every masked cell that hides a value: (scenario, group, station, ts, truth, regressors).

    A scenario's sums are the panel's less those of its masked cells. The panel is summed once for all scenarios, and what
    is made per scenario is in proportion to the masked cells. The same numbers as decomposing each blanked panel.
    """
    group = list(group)
    calendar = effects.with_calendar(panel, ts).where(F.col(value).isNotNull())
    hidden = (calendar.join(mask.select("scenario", "station", ts).distinct(), ["station", ts])
              .select("scenario", *group, "station", ts, F.col(value).alias("truth"), *effects.KINDS))
    bucket = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("int").alias("bucket")) for k in effects.KINDS]))

    # Station means per bucket, before and after hiding.
    place = [*group, "station", "kind", "bucket"]
    whole = (calendar.select(*group, "station", F.col(value).alias("_v"), bucket.alias("_k"))
             .groupBy(*group, "station", "_k.kind", "_k.bucket").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n")))
    less = (hidden.select("scenario", *group, "station", "truth", bucket.alias("_k"))
            .groupBy("scenario", *group, "station", "_k.kind", "_k.bucket").agg(F.sum("truth").alias("_ds"), F.count("truth").alias("_dn")))
    left = less.join(whole, place).withColumns({
        "_was": F.col("_s") / F.col("_n"),
        "_mean": F.when(F.col("_n") > F.col("_dn"), (F.col("_s") - F.col("_ds")) / (F.col("_n") - F.col("_dn")))})
    # Means over the stations: the panel's, moved by the stations whose mean moved or went.
    level = [*group, "kind", "bucket"]
    overall = whole.groupBy(*level).agg(F.sum(F.col("_s") / F.col("_n")).alias("_t"), F.count(F.lit(1)).alias("_c"))
    moved = left.groupBy("scenario", *level).agg(F.sum(F.coalesce("_mean", F.lit(0.0)) - F.col("_was")).alias("_dt"),
                                                 F.count_if(F.col("_mean").isNull()).alias("_dc"))
    moved = moved.join(overall, level).select(
        "scenario", *level, F.try_divide(F.col("_t") + F.col("_dt"), F.col("_c") - F.col("_dc")).alias("_overall"))
    effect = left.join(moved, ["scenario", *level]).select(
        "scenario", *place, F.coalesce(F.col("_mean") - F.col("_overall"), F.lit(0.0)).alias("_effect"))
    # A station's masked buckets of one scenario are at most 53 + 7 + 24.
    entry = F.struct(F.concat_ws(":", "kind", "bucket"), F.col("_effect"))
    packed = effect.groupBy("scenario", *group, "station").agg(F.map_from_entries(F.collect_list(entry)).alias("_effects"))

    hour = [*group, *effects.KINDS]
    peers = calendar.groupBy(*hour).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    gone = hidden.groupBy("scenario", *hour).agg(F.sum("truth").alias("_ds"), F.count("truth").alias("_dn"))
    rest = gone.join(peers, hour).select(
        "scenario", *hour, F.try_divide(F.when(F.col("_n") > F.col("_dn"), F.col("_s") - F.col("_ds")),
                                        F.col("_n") - F.col("_dn")).alias("peer_mean"))
    rows = hidden.join(rest, ["scenario", *hour]).join(packed, ["scenario", *group, "station"])
    return rows.select("scenario", *group, "station", ts, "truth", "peer_mean", *[
        F.try_element_at("_effects", F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))).alias(f"{k}_effect") for k in effects.KINDS])


def imputation_estimates(
    panel: DataFrame, mask: DataFrame, scenarios: int, methods: Sequence[str] = tuple(effects.METHODS),
) -> DataFrame:
    """(method, scenario, pollutant, truth, estimate) of every masked cell that hides a value.

    The regressors of the masked cells come from sums by subtraction, once for all methods. Fitted weights need each
    scenario's whole panel, as every row's regressors move with a bucket's mean: one decomposition gives the cross
    products of a station, whose sums over stations are those of the pollutant.
    """
    unknown = set(methods) - set(effects.METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    key = ["scenario", "pollutant"]
    rows = masked_regressors(panel, mask)
    x = [F.col(c) for c in effects.REGRESSORS]
    fixed = sum((F.lit(w) * c for w, c in zip(effects.WEIGHTS[1:], x[1:], strict=True)), x[0])
    estimates = {"sdem": fixed}
    if set(methods) - {"sdem"}:
        whole = effects.decomposition(masked_panel(panel, mask, scenarios), group=key)
        sums = grouped_moments(whole, [*key, "station"], x, F.col("x")).where(F.col("moments")[0].isNotNull()).checkpoint()
        size = len(x) * (len(x) + 1) // 2 + len(x)
        added = sums.groupBy(*key).agg(F.array(*[F.sum(F.col("moments")[i]) for i in range(size)]).alias("moments"))
        for name, table, by in (("sdem_global_weights", added, key), ("sdem_station_weights", sums, [*key, "station"])):
            if name in methods:
                weights = table.select(*by, solve_moments("moments").alias(f"_{name}"))
                rows = rows.join(weights, by, "left")
                estimates[name] = linear_predictor(F.col(f"_{name}"), x)
    each = F.array(*[F.struct(F.lit(m).alias("method"), clip_floor(estimates[m]).alias("estimate")) for m in methods])
    return rows.select(*key, "truth", F.explode(each).alias("_e")).select("_e.method", *key, "truth", "_e.estimate")


def evaluate_imputation(
    panel: DataFrame, mask: DataFrame, scenarios: int, methods: Sequence[str] = tuple(effects.METHODS),
) -> DataFrame:
    """Scores per (method, scenario, pollutant) of the decomposition methods on the same masks, in one plan."""
    return score(imputation_estimates(panel, mask, scenarios, methods), ["method", "scenario", "pollutant"])


def gwr_fill(
    panel: DataFrame, target: str, covariates: Sequence[str], bandwidth: float, keys: Sequence[str] = ("station",),
    ts: str = "ts", forward: bool = True,
) -> DataFrame:
    """Local models at every station, backward and forward, then the recursive fill."""
    keys = list(keys)
    outer = [k for k in keys if k != "station"]
    features = panel_features(panel, target, covariates, keys, ts)
    places = panel.select(*outer, "station", "lon", "lat").distinct()

    def local(names: list[str]) -> DataFrame:
        return spatial_regression.gwr(features, places, target, names, bandwidth, outer)
    back = local(regression.backward_features(target, covariates))
    ahead = local(regression.forward_features(target, covariates)) if forward else None
    return recursion.directional_fill(panel, features, back, ahead, keys, target, covariates, ts, keys)


def compare_methods(
    panel: DataFrame, mask: DataFrame, scenarios: int, target: str, covariates: Sequence[str], bandwidth: float,
    warm_hours: int = 6,
) -> DataFrame:
    """Five methods on the same masks: scores per (method, scenario).

    ``panel`` is wide: station, lon, lat, ts, the target and complete covariates. The first hours are filled by the
    fixed-weight decomposition so that every later hour has its lags.
    """
    spread = masked_panel(panel, mask, scenarios, value=target)
    warmed = effects.warm_up(spread, warm_hours, target, "ts", ["scenario"]).checkpoint()
    keys = ["scenario", "station"]
    bare = warmed.drop("truth")
    runs: Mapping[str, DataFrame] = {
        "sdem": effects.sdem(bare, target, "ts", ["scenario"]),
        "sdem_global_weights": effects.sdem_global_weights(bare, target, "ts", ["scenario"]),
        "sdem_station_weights": effects.sdem_station_weights(bare, target, "ts", ["scenario"]),
        "station_glm": recursion.glm_fill(bare, target, covariates, keys),
        "gwr": gwr_fill(bare, target, covariates, bandwidth, keys),
    }
    truth = warmed.where(F.col("truth").isNotNull()).select(*keys, "ts", "truth")
    stacked = None
    for name, filled in runs.items():
        part = truth.join(filled.select(*keys, "ts", F.col(target).alias("estimate")), [*keys, "ts"]).select(
            F.lit(name).alias("method"), "scenario", "truth", "estimate")
        stacked = part if stacked is None else stacked.unionByName(part)
    return score(stacked, ["method", "scenario"])
