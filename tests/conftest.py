import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    from stationweave import configure
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def panel_frame(spark):
    """Three stations, 10 days, one pollutant, with gaps; the first station misses its first and last hour."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    hours = pd.date_range("2024-03-25", periods=240, freq="h")
    frames = []
    for i, name in enumerate(["A001", "B002", "C003"]):
        x = 20 + 5 * i + 3 * np.sin(np.arange(240) / 24 * 2 * np.pi) + rng.normal(0, 1, 240)
        x[rng.random(240) < 0.15] = np.nan
        if i == 0:
            x[[0, -1]] = np.nan
        frames.append(pd.DataFrame({"station": name, "pollutant": "pm", "ts": hours, "x": x}))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_frame):
    import pyspark.sql.functions as F
    df = spark.createDataFrame(panel_frame)
    return df.withColumns({"x": F.when(~F.isnan("x"), F.col("x")), "ts": F.col("ts").cast("timestamp")}).checkpoint()
