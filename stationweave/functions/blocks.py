"""Distance work between two point sets in bounded blocks.

Sources and targets are packed into spatial blocks of bounded size. Blocks, not rows, are matched through an equi-join
on the target block, and each matched pair is reduced inside an Arrow task to one partial row per target. Partials are
then combined by an ordinary aggregation, so no task holds a whole date, tile or station set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from stationweave.functions.columns import EARTH_RADIUS_KM

KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180


def source_blocks(
    df: DataFrame,
    keys: Sequence[str],
    identity: str,
    payload: Sequence[str],
    tile: float | Column,
    rows: int,
) -> DataFrame:
    """Pack rows with lon/lat into blocks per (keys, tile); a crowded tile is split by a hash of its identity."""
    keys = list(keys)
    tiled = df.withColumns({"_tx": F.floor(F.col("lon") / tile), "_ty": F.floor(F.col("lat") / tile)})
    where = [*keys, "_tx", "_ty"]
    sizes = tiled.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    for c in where:
        tiled = tiled.where(F.col(c).isNotNull())
    # Every row has its size; as a left join only the sizes can be broadcast, not rows whose number the optimizer can't see.
    return (tiled.join(sizes, where, "left")
            .withColumn("_part", F.pmod(F.xxhash64(identity), F.col("_parts")))
            .groupBy(*where, "_part")
            .agg(F.collect_list(F.struct("lon", "lat", *payload)).alias("sources"),
                 F.count(F.lit(1)).alias("n_sources"),
                 F.min("lon").alias("lon0"), F.max("lon").alias("lon1"),
                 F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
            .withColumnRenamed("_part", "part").drop("_tx", "_ty"))


def km_matrix(lon_a: np.ndarray, lat_a: np.ndarray, lon_b: np.ndarray, lat_b: np.ndarray) -> np.ndarray:
    """Great-circle distances a x b; half-angle differences come from outer products."""
    def half(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.radians(values) / 2
        return np.sin(r), np.cos(r)
    (sa, ca), (sb, cb) = half(lat_a), half(lat_b)
    dlat = np.outer(sa, cb) - np.outer(ca, sb)
    (so, co), (sp, cp) = half(lon_a), half(lon_b)
    dlon = np.outer(so, cp) - np.outer(co, sp)
    h = dlat ** 2 + np.outer(np.cos(np.radians(lat_a)), np.cos(np.radians(lat_b))) * dlon ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0)))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    return column.offsets.to_numpy(), column.values


def reduce_pairs(
    pairs: DataFrame,
    keys: Sequence[str],
    target_fields: Sequence[str],
    source_fields: Sequence[str],
    kernel: Callable[[dict, dict], dict],
    output: T.StructType,
) -> DataFrame:
    """Apply ``kernel(targets, sources)`` to every matched block pair.

    ``pairs`` has list columns ``targets`` and ``sources``. The kernel gets arrays by field name and returns arrays by
    output column name; the entry ``_targets`` of its result says how many rows it made. Keys are repeated on each.
    """
    keys = list(keys)
    frame = pairs.select(*keys, "targets", "sources")
    schema = T.StructType([f for f in frame.schema.fields if f.name in keys] + output.fields)
    names = [f.name for f in output.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t_off, t_val = _lists(batch.column("targets"))
            s_off, s_val = _lists(batch.column("sources"))
            targets = {f: _numpy(t_val.field(f)) for f in target_fields}
            sources = {f: _numpy(s_val.field(f)) for f in source_fields}
            columns: dict[str, list] = {n: [] for n in names}
            repeats = np.zeros(batch.num_rows, dtype=np.int64)
            pending = 0
            start = 0
            for r in range(batch.num_rows):
                part = kernel({f: v[t_off[r]:t_off[r + 1]] for f, v in targets.items()},
                              {f: v[s_off[r]:s_off[r + 1]] for f, v in sources.items()})
                repeats[r] = len(part[names[0]])
                pending += repeats[r]
                for n in names:
                    columns[n].append(part[n])
                if pending > 50_000 or r == batch.num_rows - 1:
                    index = pa.array(np.repeat(np.arange(start, r + 1), repeats[start:r + 1]))
                    made = [batch.column(k).take(index) for k in keys]
                    made += [_arrow(columns[f.name], f.dataType) for f in output.fields]
                    yield pa.RecordBatch.from_arrays(made, names=[*keys, *names])
                    columns = {n: [] for n in names}
                    pending, start = 0, r + 1

    return frame.mapInArrow(run, schema)


def _numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        width = len(column.values) // max(len(column), 1)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return column.to_numpy(zero_copy_only=False)


def _arrow(parts: list[np.ndarray], kind: T.DataType) -> pa.Array:
    values = np.concatenate(parts)
    if isinstance(kind, T.ArrayType):
        offsets = pa.array(np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
    if isinstance(kind, T.StringType):
        return pa.array(values, pa.string())
    if isinstance(kind, T.LongType):
        return pa.array(values, pa.int64())
    return pa.array(values, pa.float64())
