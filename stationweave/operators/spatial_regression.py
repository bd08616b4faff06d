"""Geographically and temporally weighted regression from per-station sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from stationweave.functions.blocks import reduce_pairs, source_blocks
from stationweave.functions.linalg import grouped_moments, solve_moments, unpack
from stationweave.operators.regression import design
from stationweave.session import ensure_checkpoint_dir

# A Gaussian weight is exactly 0 in double precision beyond this many bandwidths.
UNDERFLOW = math.sqrt(2 * 746.0)
# Fixed value: share of the space distance in the space-time distance.
SPACE_SHARE = 0.05
# Hours of the week; places of a side that meet in one task, and that one matrix product takes.
WEEK = 168
GROUP_PLACES, BLOCK_PLACES = 2048, 128


def station_moments(rows: DataFrame, keys: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    """Cross products per station (and further keys), with lon/lat: the only pass over the data."""
    return _known(grouped_moments(rows, [*keys, "lon", "lat"], design(features), F.col(target)))


def _known(statistics: DataFrame) -> DataFrame:
    """Stations with at least one complete row."""
    return statistics.where(F.col("moments")[0].isNotNull())


def _pairs(statistics: DataFrame, targets: DataFrame, keys: list[str], payload: list[str], reach: float | Column) -> DataFrame:
    """Blocks of targets with the blocks of statistics within reach: (keys, targets, sources).

    Target blocks, the lighter ones, are copied to the tiles within the kernel's exact reach and met by an equi-join. The
    reach may be a column over the keys.
    """
    tile = F.greatest((reach if isinstance(reach, Column) else F.lit(float(reach))) / 2, F.lit(1e-6))
    sources = source_blocks(statistics, keys, "station", payload, tile, rows=128)

    def home(corner: str) -> Column:
        return F.floor(F.col(corner) / tile)

    def tiles(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(low) - reach) / tile), F.floor((F.col(high) + reach) / tile)))
    known = sources.withColumns({"_gx": home("lon0"), "_gy": home("lat0")}).select(*keys, "_gx", "_gy", "sources")
    wanted = source_blocks(targets, keys, "station", ["station"], tile, rows=128)
    spread = (wanted.withColumn("_gx", tiles("lon0", "lon1")).withColumn("_gy", tiles("lat0", "lat1"))
              .select(*keys, "_gx", "_gy", F.col("sources").alias("targets")))
    # Sizes seen by the optimizer leave out the copies, and what blocks hold: neither side is left to be broadcast by them.
    return spread.hint("merge").join(known, [*keys, "_gx", "_gy"])


def _weighted_sums(statistics: DataFrame, targets: DataFrame, keys: list[str], bandwidth: float) -> DataFrame:
    """Kernel-weighted sum of the statistics at every target station: (keys, target, moments).

    A block pair is one matrix product.
    """
    return _array_sum(_weighted_parts(statistics, targets, keys, [bandwidth], False), [*keys, "station"])


def _weighted_parts(
    statistics: DataFrame, targets: DataFrame, keys: list[str], bandwidths: Sequence[float], leave_out: bool,
) -> DataFrame:
    """One weighted sum per bandwidth, target and block of statistics; all bandwidths share one pairing."""
    payload = ["station", "moments"]
    pairs = _pairs(statistics, targets, keys, payload, UNDERFLOW * max(bandwidths))

    def kernel(t: dict, s: dict) -> dict:
        d = np.hypot(t["lon"][:, None] - s["lon"][None, :], t["lat"][:, None] - s["lat"][None, :])
        own = t["station"][:, None] == s["station"][None, :] if leave_out else None
        parts = []
        for h in bandwidths:
            w = np.exp(-0.5 * (d / h) ** 2)
            if own is not None:
                w[own] = 0.0
            parts.append(w @ s["moments"])
        return {"station": np.tile(t["station"], len(parts)), "bandwidth": np.repeat(np.asarray(bandwidths, float), len(d)),
                "part": np.concatenate(parts)}

    fields = T.StructType([T.StructField("station", T.StringType()), T.StructField("bandwidth", T.DoubleType()),
                           T.StructField("part", T.ArrayType(T.DoubleType()))])
    return reduce_pairs(pairs, keys, ["lon", "lat", "station"], ["lon", "lat", *payload], kernel, fields)


def _entry_sums(parts: DataFrame, keys: list[str], features: int) -> DataFrame:
    """``_array_sum`` of packed systems with a row per part instead of one per entry."""
    size = features * (features + 1) // 2 + features
    return parts.groupBy(*keys).agg(F.array(*[F.sum(F.col("part")[i]) for i in range(size)]).alias("moments"))


def _array_sum(parts: DataFrame, keys: list[str]) -> DataFrame:
    entries = parts.select(*keys, F.posexplode("part").alias("_at", "_v"))
    summed = entries.groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    # One entry per model coefficient pair: the list is as long as the packed system, whatever the data.
    return (summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_all"))
            .select(*keys, F.transform("_all", lambda e: e["_v"]).alias("moments")))


def gwr(
    rows: DataFrame, targets: DataFrame, target: str, features: Sequence[str], bandwidth: float,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Local coefficients at every target station: (keys, station, coefficients), intercept first.

    Gaussian kernel on coordinate distance (degrees). ``targets`` holds keys, station, lon, lat and may name stations
    without any observation.
    """
    keys = list(keys)
    statistics = station_moments(rows, [*keys, "station"], target, features)
    sums = _weighted_sums(statistics, targets.select(*keys, "station", "lon", "lat"), keys, bandwidth)
    return sums.select(*keys, "station", solve_moments("moments").alias("coefficients"))


def gtwr(
    rows: DataFrame, targets: DataFrame, target: str, features: Sequence[str], bandwidth: float = 0.2,
    time: str = "time",
) -> DataFrame:
    """Local coefficients per (station, hour of the week) with a kernel on space and time together.

    The space-time distance is (sqrt(a * space) + sqrt((1 - a) * hours)) ** 2 with a = SPACE_SHARE. A lag in hours counts
    only for the stations that the rest of the distance still reaches (``lag_reaches``), so the pairs thin out as the
    hours grow apart.
    """
    statistics = station_moments(rows, ["station", time], target, features)
    slots = targets.select("station", "lon", "lat").withColumn(
        time, F.explode(F.sequence(F.lit(1), F.lit(168))))
    parts = _timed_parts(statistics, slots, time, [bandwidth], leave_out=False)
    return _entry_sums(parts, [time, "station"], len(features) + 1).select("station", time, solve_moments("moments").alias("coefficients"))


def _timed_parts(
    statistics: DataFrame, slots: DataFrame, time: str, bandwidths: Sequence[float], leave_out: bool,
) -> DataFrame:
    """Weighted sums per bandwidth and (station, hour of the week), for each lag within the widest bandwidth's reach.

    A place carries its whole week, so what is paired are places: all lags of a pair share its distance, and a statistic
    isn't copied to the hours it reaches. Places of a tile meet in groups of bounded size, targets copied to the tiles
    within the widest reach; a group of targets and one of statistics leave one partial row per target cell.
    """
    place, reach = ["station", "lon", "lat"], lag_reaches(max(bandwidths))[0]
    tile = F.lit(max(reach / 2, 1e-6))
    size = statistics.schema[time].dataType

    def tiles(at: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(at) - reach) / tile), F.floor((F.col(at) + reach) / tile)))
    sources = (statistics.where(F.col(time).isNotNull())
               .groupBy(*place).agg(F.collect_list(F.struct(F.col(time).cast("long").alias("at"), "moments")).alias("cells"))
               .withColumns({"_gx": F.floor(F.col("lon") / tile), "_gy": F.floor(F.col("lat") / tile)}))
    targets = (slots.where(F.col(time).between(1, WEEK)).groupBy(*place)
               .agg(F.collect_list(F.col(time).cast("long")).alias("slots"))
               .withColumn("_gx", tiles("lon")).withColumn("_gy", tiles("lat")))

    def groups(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("_gx", "_gy").agg(F.ceil(F.count(F.lit(1)) / GROUP_PLACES).alias(name))

    # Their sizes say little about copied rows, so nothing here is left to be broadcast by them.
    counts = groups(sources, "_sn").hint("merge").join(groups(targets, "_tn"), ["_gx", "_gy"])

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with their own group, once for every group of the other side."""
        return (rows.hint("merge").join(counts, ["_gx", "_gy"])
                .withColumn(f"_{own}", F.pmod(F.xxhash64(*place), F.col(f"_{own}n")))
                .withColumn(f"_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_{other}n") - 1)))
                .drop("_sn", "_tn"))
    keys = ["_gx", "_gy", "_t", "_s"]
    widths = [float(h) for h in bandwidths]

    def run(wanted: pa.Table, known: pa.Table) -> pa.Table:
        return _timed_sums(wanted, known, time, widths, leave_out)
    schema = T.StructType([T.StructField("station", T.StringType()), T.StructField(time, T.LongType()),
                           T.StructField("bandwidth", T.DoubleType()), T.StructField("part", T.ArrayType(T.DoubleType()))])
    right = dealt(sources, "s", "t")
    # Both sides may come from one table; new names keep them apart.
    parts = (dealt(targets, "t", "s").groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys))
             .applyInArrow(run, schema))
    return parts.withColumn(time, F.col(time).cast(size))


def _timed_sums(wanted: pa.Table, known: pa.Table, time: str, bandwidths: list[float], leave_out: bool) -> pa.Table:
    """Weighted sums of a group of places with their cells at the cells of another group.

    A target cell gets rows, one per bandwidth, if a cell of the group lies within its reach. Blocks of near places are one
    matrix product per lag; lags whose reach ends before a pair of blocks are left out.
    """
    reaches = lag_reaches(max(bandwidths))
    lags = len(reaches) - 1
    if not wanted.num_rows or not known.num_rows:
        return _timed_table([], [], [], [], time)
    t, s = _places(wanted), _places(known)
    codes = pd.factorize(np.concatenate([t["station"], s["station"]]), use_na_sentinel=False)[0]
    t["code"], s["code"] = codes[:len(t["lon"])], codes[len(t["lon"]):]
    cells = known.column("cells").combine_chunks().take(pa.array(s["order"]))
    flat = cells.flatten()
    at, packed = flat.field("at").to_numpy(zero_copy_only=False), flat.field("moments")
    moments = packed.flatten().to_numpy(zero_copy_only=False).reshape(len(packed), -1)
    owner = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy(zero_copy_only=False))
    slots = wanted.column("slots").combine_chunks().take(pa.array(t["order"]))
    slot = slots.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(slots)), slots.value_lengths().to_numpy(zero_copy_only=False))
    q, out = moments.shape[1], ([], [], [], [])
    use = (at >= 1 - lags) & (at <= WEEK + lags)
    owner, at, moments = owner[use], at[use] - 1 + lags, moments[use]
    blocks = []
    for first in range(0, len(s["lon"]), BLOCK_PLACES):
        n = min(BLOCK_PLACES, len(s["lon"]) - first)
        mine = (owner >= first) & (owner < first + n)
        # The week with the hours that lags reach on both sides.
        week, there = np.zeros((n, WEEK + 2 * lags, q)), np.zeros((n, WEEK + 2 * lags), dtype=np.float32)
        np.add.at(week, (owner[mine] - first, at[mine]), moments[mine])
        there[owner[mine] - first, at[mine]] = 1
        # One value that isn't finite would spoil a whole product.
        odd = (~np.isfinite(week)).any(axis=2)
        week[odd] = 0.0
        blocks.append((slice(first, first + n), week, there, odd.astype(np.float32) if odd.any() else None))
    for first in range(0, len(t["lon"]), BLOCK_PLACES):
        rows = slice(first, min(first + BLOCK_PLACES, len(t["lon"])))
        n = rows.stop - rows.start
        sums, seen = np.zeros((len(bandwidths) * n, WEEK * q)), np.zeros((n, WEEK), dtype=bool)
        bad = np.zeros((n, WEEK), dtype=bool)
        for places, week, there, odd in blocks:
            d = np.hypot(t["lon"][rows, None] - s["lon"][None, places], t["lat"][rows, None] - s["lat"][None, places])
            own = t["code"][rows, None] == s["code"][None, places] if leave_out else None
            nearest = d.min()
            for lag, reach in enumerate(reaches):
                if nearest > reach:
                    break
                within = (d <= reach).astype(np.float32)
                seen |= within @ _around(there, lag, lags) > 0
                if odd is not None:
                    bad |= within @ _around(odd, lag, lags) > 0
                far = (np.sqrt(SPACE_SHARE * d) + np.sqrt((1 - SPACE_SHARE) * lag)) ** 2
                w = np.concatenate([np.exp(-0.5 * (far / h) ** 2) for h in bandwidths])
                if own is not None:
                    w[np.tile(own, (len(bandwidths), 1))] = 0.0
                sums += w @ _around(week, lag, lags).reshape(len(week), -1)
        sums = sums.reshape(len(bandwidths), n, WEEK, q)
        sums[:, bad] = np.nan
        mine = (of >= rows.start) & (of < rows.stop)
        place, hour = of[mine], slot[mine] - 1
        found = seen[place - first, hour]
        place, hour = place[found], hour[found]
        for i, h in enumerate(bandwidths):
            out[0].append(t["station"][place])
            out[1].append(hour + 1)
            out[2].append(np.full(len(place), h))
            out[3].append(sums[i, place - first, hour])
    return _timed_table(*out, time)


def _timed_table(stations: list, hours: list, bandwidths: list, sums: list, time: str) -> pa.Table:
    """A batch per block and bandwidth."""
    schema = pa.schema([("station", pa.string()), (time, pa.int64()), ("bandwidth", pa.float64()), ("part", pa.list_(pa.float64()))])
    made = []
    for a, b, c, v in zip(stations, hours, bandwidths, sums, strict=True):
        ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
        made.append(pa.RecordBatch.from_arrays(
            [pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c), pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1)))],
            schema=schema))
    return pa.Table.from_batches(made, schema)


def _places(table: pa.Table) -> dict[str, np.ndarray]:
    """Stations and coordinates with near places side by side: strips of longitude, each by latitude."""
    lon, lat = (table.column(c).to_numpy().astype(float) for c in ("lon", "lat"))
    strips = max(1, round(math.sqrt(len(lon) / BLOCK_PLACES)))
    strip = np.argsort(np.argsort(lon, kind="stable"), kind="stable") * strips // len(lon)
    order = np.lexsort((lat, strip))
    return {"order": order, "station": np.array(table.column("station").to_pylist(), dtype=object)[order],
            "lon": lon[order], "lat": lat[order]}


def _around(week: np.ndarray, lag: int, lags: int) -> np.ndarray:
    """What lies ``lag`` hours before and after each hour of the week."""
    before = week[:, lags - lag:lags - lag + WEEK]
    return before + week[:, lags + lag:lags + lag + WEEK] if lag else before


def lag_reaches(bandwidth: float) -> list[float]:
    """Degrees within which a Gaussian space-time weight isn't exactly zero, for 0, 1, 2, ... hours apart."""
    most = UNDERFLOW * bandwidth
    hours = math.floor(most / (1 - SPACE_SHARE))
    return [(math.sqrt(most) - math.sqrt((1 - SPACE_SHARE) * lag)) ** 2 / SPACE_SHARE for lag in range(hours + 1)]


def bandwidth_cv(
    rows: DataFrame, target: str, features: Sequence[str], candidates: Sequence[float], time: str | None = None,
) -> DataFrame:
    """Leave-one-station-out error of every candidate bandwidth, best first: (bandwidth, cv_error).

    With ``time``, the column of the hour of the week, the kernel is the one of ``gtwr`` and a (station, hour) cell is
    judged by the coefficients that all other stations give it. The error of a cell under its neighbours' coefficients
    follows from its own cross products, so the data is read once. The cells are paired once for all candidates, within
    the reach of the widest; a cell to which a narrower candidate gives no weight counts with coefficients of zero. A cell
    without any neighbour in that reach counts for no candidate.
    """
    return _cv_scores(_cv_statistics(rows, target, features, time), len(features) + 1, candidates, time).orderBy(
        "cv_error", "bandwidth")


def _cv_statistics(rows: DataFrame, target: str, features: Sequence[str], time: str | None) -> DataFrame:
    y = F.col(target)
    return _known(grouped_moments(rows, ["station", *([time] if time else []), "lon", "lat"], design(features), y,
                                  extra={"_yy": F.sum(F.col("_use") * y * y)}))


def _cv_scores(statistics: DataFrame, p: int, candidates: Sequence[float], time: str | None) -> DataFrame:
    """One row per candidate, from one pairing of the statistics."""
    @F.pandas_udf(T.DoubleType())
    def error(coefficients: pd.Series, packed: pd.Series, yy: pd.Series) -> pd.Series:
        out = np.full(len(yy), np.nan)
        use = (coefficients.notna() & packed.notna() & yy.notna()).to_numpy()
        if use.any():
            b, m = (np.array(c[use].tolist(), float) for c in (coefficients, packed))
            gram, right = unpack(m, p)
            out[use] = yy[use] - 2 * (b * right).sum(axis=1) + np.einsum("ni,nij,nj->n", b, gram, b)
        return pd.Series(out).where(use, None)

    widths = sorted({float(h) for h in candidates})
    if time:
        cell = ["station", time]
        known = statistics.select(*cell, "lon", "lat", "moments")
        parts = _timed_parts(known, statistics.select(*cell, "lon", "lat"), time, widths, leave_out=True)
        sums = _entry_sums(parts, ["bandwidth", *cell], p)
    else:
        cell = ["station"]
        parts = _weighted_parts(statistics, statistics.select("station", "lon", "lat"), [], widths, True)
        sums = _array_sum(parts, ["bandwidth", *cell])
    local = sums.select("bandwidth", *cell, solve_moments("moments").alias("_b"))
    return (local.join(statistics, cell).select("bandwidth", error("_b", "moments", "_yy").alias("_e"))
            .groupBy("bandwidth").agg(F.sum("_e").alias("cv_error")))


def bandwidth_search(
    rows: DataFrame, target: str, features: Sequence[str], low: float, high: float, points: int = 5, rounds: int = 3,
    time: str | None = None,
) -> DataFrame:
    """Interval search for the bandwidth of least leave-one-station-out error, best first: (round, bandwidth, cv_error).

    Each round scores ``points`` bandwidths, spaced evenly in the logarithm from end to end of the interval, by one pairing
    (``bandwidth_cv``); the next interval lies between the neighbours of the best one, so it shrinks by (points - 1) / 2 a
    round, or by points - 1 where the best one is an end. The smaller bandwidth wins a tie. The cross products are made
    once; the driver sees ``points`` numbers a round.
    """
    if not 0 < low < high or points < 3 or rounds < 1:
        raise ValueError("needs 0 < low < high, at least 3 points and 1 round")
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    statistics = _cv_statistics(rows, target, features, time).checkpoint()
    seen: list[tuple[int, float, float | None]] = []
    for number in range(1, rounds + 1):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        found = {r["bandwidth"]: r["cv_error"] for r in _cv_scores(statistics, len(features) + 1, grid, time).collect()}
        seen += [(number, h, found.get(h)) for h in grid]
        scored = [i for i, h in enumerate(grid) if found.get(h) is not None]
        if not scored:
            break
        best = min(scored, key=lambda i: (found[grid[i]], i))
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    scores = spark.createDataFrame(seen, "round int, bandwidth double, cv_error double")
    return scores.orderBy(F.col("cv_error").asc_nulls_last(), "bandwidth", "round")


def best_bandwidth(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("cv_error").isNotNull()).orderBy("cv_error", "bandwidth").limit(1)


def daily_coefficients(
    rows: DataFrame, targets: DataFrame, target: str, features: Sequence[str], bandwidth: float, window: int = 7,
    every: int = 1, ts: str = "ts",
) -> DataFrame:
    """Local coefficients of ``gwr`` refitted every ``every`` days on the ``window`` days before: (day, station, coefficients).

    Cross products of least squares add up over days, so a day's products are made once and summed into the windows they
    belong to. Refit days are counted from the epoch; one gets a table where its window holds a complete row.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    daily = station_moments(rows.withColumn("_day", F.to_date(ts)), ["station", "_day"], target, features).checkpoint()

    def refits(first: Column, last: Column) -> Column:
        """The refit days between two days, as rows."""
        begin = F.date_add(first, F.pmod(-F.unix_date(first), F.lit(every)).cast("int"))
        return F.explode(F.when(begin <= last, F.sequence(begin, last, F.make_dt_interval(days=F.lit(every)))))

    served = daily.withColumn("day", refits(F.date_add("_day", 1), F.date_add("_day", window)))
    entries = served.select("station", "day", "lon", "lat", F.posexplode("moments").alias("_at", "_v"))
    summed = entries.groupBy("station", "day", "lon", "lat", "_at").agg(F.sum("_v").alias("_v"))
    statistics = summed.groupBy("station", "day", "lon", "lat").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda e: e["_v"]).alias("moments"))
    # Two dates: a place wants every refit day, measured in its window or not.
    span = daily.agg(F.min("_day").alias("low"), F.max("_day").alias("high")).first()
    wanted = targets.select("station", "lon", "lat").withColumn(
        "day", refits(F.date_add(F.lit(span["low"]).cast("date"), 1), F.date_add(F.lit(span["high"]).cast("date"), window)))
    sums = _weighted_sums(statistics, wanted, ["day"], bandwidth)
    return sums.select("day", "station", solve_moments("moments").alias("coefficients"))
