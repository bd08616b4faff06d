"""Hour-by-hour imputation in which a filled hour feeds the next one.

Only missing hours are moved. A missing hour depends on another missing hour only when that one lies within the
largest lag, so the missing hours of a group fall into independent runs; runs, not stations, are the unit of work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stationweave.functions.columns import CLIP_FLOOR, hour_index
from stationweave.functions.sequences import nearest_observed
from stationweave.operators.panel import LAGS, panel_features
from stationweave.operators.regression import (
    backward_features, design, forest, forest_nodes, forward_features, lead_names, station_glm,
)
from stationweave.operators.selection import any_null

# Model rows and coefficients, one matrix each, to one number a row.
Predictor = Callable[[np.ndarray, np.ndarray], np.ndarray]
# Missing hours that a task fills at a time, and cells of the matrix in which rows walk down trees.
LOCKSTEP_ROWS = 20_000
WALK_CELLS = 1_000_000


def _dot(features: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", features, coefficients)


def with_runs(missing: DataFrame, keys: Sequence[str], ts: str, reach: int) -> DataFrame:
    """Add ``_hour`` and ``_run``, the first hour of the run a missing row belongs to."""
    rows = missing.withColumn("_hour", hour_index(ts))
    rows = nearest_observed(rows, keys, ts, "_hour", previous="_before")
    opens = F.col("_before").isNull() | (F.col("_hour") - F.col("_before") > reach)
    rows = rows.withColumn("_open", F.when(opens, F.col("_hour")))
    rows = nearest_observed(rows, keys, ts, "_open", previous="_opened")
    return rows.withColumn("_run", F.coalesce("_open", "_opened")).drop("_before", "_open", "_opened")


def recursive_fill(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, features: Column, lag_positions: Mapping[int, int],
    coefficients: Column | None = None, predict: Predictor = _dot, floor: float = CLIP_FLOOR,
) -> DataFrame:
    """Fill NULL cells in time order.

    ``features`` is the model row as an array column; entry ``lag_positions[k]`` is the value k hours earlier and is
    replaced by the filled value where that hour was missing. Cells whose features stay incomplete stay NULL.

    Runs are filled in lock-step: the k-th missing hours of all runs of a batch are one call of ``predict``, which takes
    a matrix of model rows and a matrix of coefficients. A run that goes on in the next batch hands its last hours over.
    """
    keys = list(keys)
    reach = max(lag_positions)
    missing = df.where(F.col(value).isNull()).select(
        *keys, F.col(ts).alias("_ts"), features.cast("array<double>").alias("_features"),
        (coefficients if coefficients is not None else F.array(F.lit(0.0))).cast("array<double>").alias("_coefficients"))
    runs = with_runs(missing, keys, "_ts", reach)
    ordered = (runs.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_hour")
               .select(*keys, "_ts", "_run", "_hour", "_features", "_coefficients"))
    positions = dict(lag_positions)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, past = None, (np.zeros(0, dtype=np.int64), np.zeros(0))
        for table in _gathered(batches, LOCKSTEP_ROWS):
            owners = list(zip(*[table.column(k).to_pylist() for k in (*keys, "_run")], strict=True))
            opens = np.array([i == 0 or owners[i] != owners[i - 1] for i in range(len(owners))])
            hours = table.column("_hour").to_numpy().astype(np.int64)
            if owners[0] != owner:
                past = (past[0][:0], past[1][:0])
            x, weights, usable = _model_rows(table.column("_features"), table.column("_coefficients"))
            made = _lockstep(x, weights, usable, np.cumsum(opens) - 1, hours, positions, predict, floor, past)
            last = np.flatnonzero(opens)[-1]
            before = past if last == 0 else (past[0][:0], past[1][:0])
            then, known = np.concatenate([before[0], hours[last:]]), np.concatenate([before[1], made[last:]])
            near = then > hours[-1] - reach
            owner, past = owners[-1], (then[near], known[near])
            yield table.select([*keys, "_ts"]).append_column("_estimate", pa.array(made)).combine_chunks().to_batches()[0]

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "_ts")) + ", _estimate double"
    estimates = ordered.mapInArrow(scan, schema).where(~F.isnan("_estimate")).withColumnRenamed("_ts", ts)
    return (df.join(estimates, [*keys, ts], "left")
            .withColumn(value, F.coalesce(value, "_estimate")).drop("_estimate").select(*df.columns))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches joined into tables of at least ``rows`` rows, the last one of what is left; none is empty."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _model_rows(features: pa.ChunkedArray, coefficients: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both list columns as matrices, shorter rows followed by zeros and NULL entries as NaN; and which rows have both."""
    pair = [pa.concat_arrays(c.chunks) for c in (features, coefficients)]
    usable = np.logical_and(*[c.is_valid().to_numpy(zero_copy_only=False) for c in pair])
    made = []
    for lists in pair:
        kept = lists.filter(pa.array(usable))
        lengths = kept.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.zeros((len(kept), int(lengths.max(initial=0))))
        rows[np.arange(rows.shape[1]) < lengths[:, None]] = kept.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), rows.shape[1]))
        out[usable] = rows
        made.append(out)
    return made[0], made[1], usable


def _lockstep(
    x: np.ndarray, weights: np.ndarray, usable: np.ndarray, run: np.ndarray, hours: np.ndarray, positions: Mapping[int, int],
    predict: Predictor, floor: float, past: tuple[np.ndarray, np.ndarray],
) -> np.ndarray:
    """Estimates of rows ordered by run and hour; ``past`` holds hours and estimates of run 0 from before. NaN: none."""
    n = len(past[0])
    if not usable.any():
        return np.full(len(hours), np.nan)
    all_hours, all_runs = np.concatenate([past[0], hours]), np.concatenate([np.zeros(n, dtype=np.int64), run])
    known = np.concatenate([past[1], np.full(len(hours), np.nan)])
    low = all_hours.min() - max(positions)
    span = all_hours.max() - low + 1
    place = all_runs * span + (all_hours - low)
    # Where the row stands that a lag names, if it is missing as well; a lag never leaves the run.
    sources = {}
    for lag, at in positions.items():
        wanted = run * span + (hours - lag - low)
        found = np.searchsorted(place, wanted, side="right") - 1
        sources[at] = np.where((found >= 0) & (place[np.maximum(found, 0)] == wanted), found, -1)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    step = np.arange(len(run)) - starts[run]
    order = np.argsort(step, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(step[order])) + 1):
        rows = rows[usable[rows]]
        for at, source in sources.items():
            gaps = rows[np.isnan(x[rows, at]) & (source[rows] >= 0)]
            x[gaps, at] = known[source[gaps]]
        rows = rows[~np.isnan(x[rows]).any(axis=1)]
        if len(rows):
            guess = predict(x[rows], weights[rows])
            known[n + rows] = np.where(guess <= 0, floor, guess)
    return known[n:]


def choose_forward_model(target: str, covariates: Sequence[str]) -> Column:
    """True when every lead of the target and the covariates is present."""
    return ~any_null([n for c in (target, *covariates) for n in lead_names(c)])


def directional_fill(
    panel: DataFrame, features: DataFrame, backward: DataFrame, forward: DataFrame | None, keys: Sequence[str],
    target: str, covariates: Sequence[str], ts: str = "ts", model_keys: Sequence[str] = ("station",),
) -> DataFrame:
    """Recursive fill with per-group coefficients; the forward model serves hours whose leads are all present."""
    model_keys = list(model_keys)
    rows = features.join(backward.withColumnRenamed("coefficients", "_b"), model_keys, "left")
    x, beta = F.array(*design(backward_features(target, covariates))), F.col("_b")
    if forward is not None:
        rows = rows.join(forward.withColumnRenamed("coefficients", "_f"), model_keys, "left")
        ahead = choose_forward_model(target, covariates) & F.col("_f").isNotNull()
        x = F.when(ahead, F.array(*design(forward_features(target, covariates)))).otherwise(x)
        beta = F.when(ahead, F.col("_f")).otherwise(beta)
    filled = recursive_fill(rows, keys, ts, target, x, {k: k for k in LAGS}, beta)
    return filled.select(*panel.columns)


def newest_tables(
    rows: DataFrame, tables: DataFrame, place: Sequence[str], day: str, name: str = "_table",
) -> DataFrame:
    """Add as ``name`` the coefficients of the newest table that isn't later than a row's day; NULL before the first.

    ``tables`` holds place, day and coefficients, one row per place and day. Only distinct places and days are ordered,
    in chunks of the calendar; the coefficients then meet the rows by place and the day of their table.
    """
    place = list(place)
    made = tables.select(*place, day, F.col(day).alias("_made"))
    asked = rows.select(*place, day, F.lit(None).cast(tables.schema[day].dataType).alias("_made"))
    days = made.unionByName(asked).groupBy(*place, day).agg(F.max("_made").alias("_made"))
    known = (nearest_observed(days, place, day, "_made", previous="_older")
             .select(*place, day, F.coalesce("_made", "_older").alias("_made")))
    entries = tables.select(*place, F.col(day).alias("_made"), F.col("coefficients").alias(name))
    return (rows.join(known, [*place, day], "left").join(entries, [*place, "_made"], "left")
            .select(*rows.columns, name))


def local_fill(
    rows: DataFrame, keys: Sequence[str], ts: str, target: str, features: Column, lag_positions: Mapping[int, int],
    tables: DataFrame, place: Sequence[str] = ("station",), at: str | None = None, newest: bool = False,
    forward: tuple[DataFrame, Column, Column] | None = None,
) -> DataFrame:
    """Recursive fill from tables of local coefficients, one per place and, with ``at``, per day or hour of the week.

    ``tables`` holds place, ``at`` and coefficients; ``newest`` takes the latest one that isn't later than the row's
    ``at``. ``forward`` is (tables by place, features, usable): rows that are usable and have such a table take it
    instead. Only missing hours meet the tables. Hours without a table stay NULL, and so do those that need them.
    """
    place = list(place)
    gaps = rows.where(F.col(target).isNull())
    if newest:
        found = newest_tables(gaps, tables, place, at)
    else:
        by = [*place, *([at] if at else [])]
        found = gaps.join(tables.select(*by, F.col("coefficients").alias("_table")), by, "left")
    x, beta = features, F.col("_table")
    if forward is not None:
        later, ahead, usable = forward
        found = found.join(later.select(*place, F.col("coefficients").alias("_later")), place, "left")
        chosen = F.coalesce(usable, F.lit(False)) & F.col("_later").isNotNull()
        x, beta = F.when(chosen, ahead).otherwise(x), F.when(chosen, F.col("_later")).otherwise(beta)
    filled = recursive_fill(found, keys, ts, target, x, lag_positions, beta).select(*rows.columns)
    return rows.where(F.col(target).isNotNull()).unionByName(filled)


def glm_fill(
    panel: DataFrame, target: str, covariates: Sequence[str], keys: Sequence[str] = ("station",), ts: str = "ts",
    forward: bool = True,
) -> DataFrame:
    """Station Gamma models, backward and optionally forward, then the recursive fill."""
    features = panel_features(panel, target, covariates, keys, ts)
    back = station_glm(features, target, covariates, keys)
    ahead = station_glm(features, target, covariates, keys, forward=True) if forward else None
    return directional_fill(panel, features, back, ahead, keys, target, covariates, ts, keys)


def forest_predictor(nodes: list[list[tuple]]) -> Predictor:
    """Mean of the trees at every feature row; all rows go down a level of a group of trees at once."""
    roots = np.cumsum([0, *map(len, nodes)])[:-1]
    flat = [(feature, cut, left + root, right + root, value)
            for tree, root in zip(nodes, roots, strict=True) for feature, cut, left, right, value in tree]
    feature, cut, left, right, value = (np.array(c) for c in zip(*flat, strict=True))

    def predict(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        total, row = np.zeros(len(x)), np.arange(len(x))[:, None]
        width = max(1, WALK_CELLS // len(x))
        for first in range(0, len(roots), width):
            at = np.broadcast_to(roots[first:first + width], (len(x), len(roots[first:first + width]))).copy()
            while (inner := feature[at] >= 0).any():
                lower = x[row, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(lower, left[at], right[at]), at)
            total += value[at].sum(axis=1)
        return total / len(roots)
    return predict


def forest_fill(
    rows: DataFrame, target: str, features: Sequence[str], lag_positions: Mapping[int, int],
    keys: Sequence[str] = ("station",), ts: str = "ts", **options,
) -> DataFrame:
    """Forest trained on complete rows, applied hour by hour."""
    model, _ = forest(rows, target, features, **options)
    predict = forest_predictor(forest_nodes(model))
    x = F.array(*[F.col(f).cast("double") for f in features])
    return recursive_fill(rows, keys, ts, target, x, lag_positions, predict=predict)
