"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Sequence
from typing import Any

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession, Window

from stationweave.session import configure, ensure_checkpoint_dir, shuffle_width

# A batch handed to Python holds whole texts, so few rows of it; very long texts are bounded by their own length.
BATCH_ROWS = 128


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for operators that hand texts to Python in Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ensure_checkpoint_dir(spark)
    return spark


# Paths made inside the calls of ``settled`` that are running, innermost last.
_open: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that ``scratch`` gave, through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a written table; every scratch path that was made on the way is deleted.

    Nothing else that ``make`` built may be used afterwards. Spark's cleaner drops shuffle files when the driver's JVM finds
    that nobody refers to them any more, which may take half an hour; it is asked to look at once.
    """
    _open.append([])
    try:
        out = written(make(), name)
        kept = _open[-1].pop()
        if len(_open) > 1:
            _open[-2].append(kept)
        return out
    finally:
        for path in _open.pop():
            discard(spark, path)
        spark._jvm.System.gc()


def uri_of(path: str) -> str:
    """The path as a URI that file systems outside Spark read as well."""
    if path.startswith("file:"):
        return "file:///" + path[len("file:"):].lstrip("/")
    return path if "://" in path else f"file://{path}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder; a lost executor loses none of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# A side of a join is broadcast up to this many rows; it must then hold a few whole numbers a row.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast if a count shows that it is small; else the join shuffles it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def width(df: DataFrame) -> int:
    return shuffle_width(df.sparkSession)


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """An object that lives as long as the Python worker, across the tasks it runs."""
    home = sys.modules.setdefault("_stationweave_worker_cache", type(sys)("_stationweave_worker_cache"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def words_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def ranked(df: DataFrame, order: Sequence[Column], name: str, label: str) -> DataFrame:
    """Add the rank from 0 in the given order as ``name`` without ordering all rows in one task.

    Rows are dealt by ranges and numbered inside each range; ranges are then shifted by the counts before them, one
    row per range.
    """
    dealt = (df.repartitionByRange(width(df), *order).sortWithinPartitions(*order)
             .withColumn("_at", F.monotonically_increasing_id()))
    held = written(dealt, label).withColumns({
        "_range": F.shiftright("_at", 33), "_inside": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (held.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    return held.join(offsets, "_range").withColumn(name, F.col("_inside") + F.col("_offset")).drop(
        "_at", "_range", "_inside", "_offset")
