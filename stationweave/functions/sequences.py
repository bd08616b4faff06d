"""Ordered operations over (group, time) without putting one group's whole history into one task.

A group's history is cut into calendar chunks. What crosses a chunk border travels either as a few halo rows (fixed
offsets) or as one summary row per chunk (unbounded look-back and look-ahead).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stationweave.functions.columns import hour_index
from stationweave.session import ensure_checkpoint_dir

CHUNK_HOURS = 24 * 28


def chunk_of(ts: Column, hours: int) -> Column:
    return F.floor(hour_index(ts) / hours).cast("long")


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    shifts: Mapping[str, tuple[str, int]],
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Add columns holding a source column k hours later (k > 0) or earlier (k < 0).

    ``shifts`` maps a new name to (source column, k). On a complete hourly panel this equals the row offset.
    """
    back = max((-k for _, k in shifts.values() if k < 0), default=0)
    ahead = max((k for _, k in shifts.values() if k > 0), default=0)
    hour = hour_index(F.col(ts))
    first = F.floor((hour - ahead) / chunk_hours).cast("long")
    last = F.floor((hour + back) / chunk_hours).cast("long")
    spread = (df.withColumn("_hour", hour).withColumn("_home", F.floor(hour / chunk_hours).cast("long"))
              .withColumn("_chunk", F.explode(F.sequence(first, last))))
    order = Window.partitionBy(*keys, "_chunk").orderBy("_hour")
    added = {}
    for name, (source, k) in shifts.items():
        there = F.lag("_hour", -k).over(order) if k < 0 else F.lead("_hour", k).over(order)
        found = F.lag(source, -k).over(order) if k < 0 else F.lead(source, k).over(order)
        added[name] = F.when(there == F.col("_hour") + k, found)
    return (spread.withColumns(added).where(F.col("_chunk") == F.col("_home"))
            .drop("_hour", "_home", "_chunk"))


def nearest_observed(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    previous: str | None = None,
    following: str | None = None,
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Add the closest non-null ``value`` strictly before and/or strictly after each row of its group."""
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk_of(F.col(ts), chunk_hours))
    seen = F.when(F.col(value).isNotNull(), F.col(ts))
    chunks = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(value, seen).alias("_last"), F.min_by(value, seen).alias("_first"))
    # One row per chunk of the calendar, so this ordering is small for every group.
    # Looking ahead is looking back in descending order: a frame that runs to the end of its partition is quadratic.
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*keys, "_chunk",
                            F.last("_last", ignorenulls=True).over(before).alias("_carry_back"),
                            F.last("_first", ignorenulls=True).over(after).alias("_carry_ahead"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    inner_back = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, -1)
    found = {}
    if previous:
        found[previous] = F.coalesce(
            F.last(value, ignorenulls=True).over(inner), F.col("_carry_back"))
    if following:
        found[following] = F.coalesce(
            F.last(value, ignorenulls=True).over(inner_back), F.col("_carry_ahead"))
    return (rows.join(carried, [*keys, "_chunk"])
            .withColumns(found).drop("_chunk", "_carry_back", "_carry_ahead"))


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    flag: Column,
    name: str,
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Add the number of flagged rows of the group up to and including each row."""
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk_of(F.col(ts), chunk_hours)).withColumn("_flag", flag.cast("long"))
    over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_chunk").agg(F.sum("_flag").alias("_n"))
               .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_offset")))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(offsets, [*keys, "_chunk"])
            .withColumn(name, F.sum("_flag").over(inner) + F.col("_offset"))
            .drop("_chunk", "_flag", "_offset"))


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number the values of a unique column 0..n-1 in their order without ordering them all in one task.

    Rows are dealt by ranges and numbered inside each; ranges are shifted by the counts before them. The checkpoint keeps
    the ranges the same for both.
    """
    ensure_checkpoint_dir(df.sparkSession)
    dealt = (df.repartitionByRange(column).sortWithinPartitions(column)
             .withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    rows = dealt.withColumns({"_range": F.shiftright("_at", 33), "_inside": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    # One row per range: the only unpartitioned ordering.
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
               .select("_range", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_offset")))
    return (rows.join(offsets, "_range").withColumn(name, F.col("_inside") + F.col("_offset"))
            .drop("_at", "_range", "_inside", "_offset"))
