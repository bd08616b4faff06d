"""Shards in Hilbert-curve order of several metadata dimensions.

Every dimension is quantised to ``BITS`` bits in its own order: numbers by approximate quantiles, strings by the rank of
the value among all distinct ones. The Hilbert index of the quantised point orders the rows, and equal runs of that order
are the shards, so a shard is compact in all dimensions at once and file statistics prune on each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from stationweave.llm._common import free_name, prepare, ranked, written

BITS = 8


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of whole-number points (rows) with ``bits`` bits per dimension.

    Works from the highest bit down: each level exchanges or inverts the lower bits so that the curve enters and leaves
    the cells of the level at neighbouring corners, then a Gray code turns cell corners into their order.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = np.int64(1) << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(dims):
            high = (x[d] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            x[d] = x[d] ^ swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    level = np.int64(1) << (bits - 1)
    while level > 1:
        turn ^= np.where((x[dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> b) & 1)
    return index


def _number_cells(df: DataFrame, column: str, bits: int) -> Column:
    """Cell of a number by approximate quantiles; null and NaN are in cell 0."""
    value = F.col(column).cast("double")
    real = F.when(~F.isnan(value), value)
    cuts = df.agg(F.percentile_approx(real, [i / (1 << bits) for i in range(1, 1 << bits)], 10_000).alias("c")).first()[0]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0).cast("long")
    bounds = F.array(*[F.lit(float(c)) for c in cuts])
    return F.coalesce(F.size(F.filter(bounds, lambda c: c <= real)), F.lit(0)).cast("long")


def hilbert_order(df: DataFrame, dimensions: Sequence[str], tie: Sequence[Column], name: str = "_place", bits: int = BITS) -> DataFrame:
    """``df`` with the rank of every row, from 0, in Hilbert order of ``dimensions``, ties by ``tie``.

    String dimensions are ranked among their distinct values, which are sorted by ranges; null is the first value.
    """
    prepare(df.sparkSession)
    cells, table = [], df
    for i, column in enumerate(dimensions):
        cell = f"_cell{i}"
        if isinstance(df.schema[column].dataType, T.StringType):
            values = ranked(df.select(F.col(column).alias("_value")).distinct(), [F.col("_value").asc_nulls_first()], "_rank", "dimension")
            values = written(values, "dimension-ranks")
            count = max(values.count(), 1)
            scaled = values.select("_value", F.floor(F.col("_rank") * (1 << bits) / F.lit(count)).cast("long").alias(cell))
            table = table.join(scaled, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")
        else:
            table = table.withColumn(cell, _number_cells(df, column, bits))
        cells.append(cell)

    @F.pandas_udf("long")
    def curve(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(points.to_numpy(dtype=np.int64), bits))

    placed = table.withColumn("_curve", curve(F.struct(*cells))).drop(*cells)
    return ranked(placed, [F.col("_curve"), *tie], name, "hilbert").drop("_curve")


def shard_of(place: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a rank when ``rows`` are cut into runs whose lengths differ by one at most."""
    small, larger = divmod(rows, shards)
    edge = larger * (small + 1)
    inside = place < edge
    shard = F.when(inside, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - edge) / max(small, 1)))
    slot = F.when(inside, place % (small + 1)).otherwise((place - edge) % max(small, 1))
    return shard.cast("int"), slot.cast("long")


def document_shards(docs: DataFrame, shards: int = 16, dimensions: Sequence[str] = ("_lang", "_source", "size", "_id"),
                    id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                    source_column: str = "source") -> DataFrame:
    """``<id>, size, text_crc32, shard, slot`` of every row.

    Dimensions are language, source, size (UTF-8 bytes of the text plus 1; a null text has none) and id. Ties are broken
    by id, size and checksum; rows equal in all of them are interchangeable. Nulls come first in every dimension. Rows
    that repeat are placed one by one. An empty table gives no rows; with fewer rows than shards the last ones are empty.
    """
    text = F.encode(F.coalesce(F.col(text_column), F.lit("")), "UTF-8")
    narrow = written(docs.select(
        F.col(id_column).alias("_id"), F.col(lang_column).alias("_lang"), F.col(source_column).alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "shard-keys")
    tie = [F.col("_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed = hilbert_order(narrow, dimensions, tie)
    shard, slot = shard_of(F.col("_place"), narrow.count(), shards)
    return placed.select(F.col("_id").alias(id_column), "size", "text_crc32", shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write the rows of ``docs``, whose ids must be unique, as one Parquet folder per shard in Hilbert order.

    The folders are named after the column ``shard``; where ``docs`` has a column of that name it is kept and the folders'
    column gets an underscore before its name (more where that is taken too).
    """
    key = options.get("id_column", "doc_id")
    of, shard, slot = (free_name(docs, n) for n in ("__key", "shard", "__slot"))
    placed = document_shards(docs, shards, **options).select(
        F.col(key).alias(of), F.col("shard").alias(shard), F.col("slot").alias(slot))
    (docs.join(placed, F.col(key).eqNullSafe(F.col(of))).drop(of)
     .repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot)
     .write.partitionBy(shard).parquet(path))
