"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Timestamps are UTC instants; skewed join partitions are split even when the split costs a shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that ``spark.checkpoint.dir`` names.

    Only a session whose executors are threads of this process may go without one; it gets a temporary folder. On a
    cluster that would be the driver's own disk, which executors cannot share, so there the setting is asked for.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="stationweave-checkpoint-")
    context.setCheckpointDir(named)


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for rows that one small table explodes into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
