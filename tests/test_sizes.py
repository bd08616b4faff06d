"""Plans of queries whose rows grow behind what the optimizer sees of their size."""

import datetime as dt

import numpy as np
import pytest

import __spark_entry__
from stationweave.functions import linalg
from stationweave.operators import evaluation, spatial_regression
from stationweave.plans import queries_models
from stationweave.plans.binding import Tables

KINDS = ["click", "error", "purchase", "signup", "view"]
QUERIES = [
    "effect_hour", "effect_week", "gap_length", "observation_gap", "boundary_fill", "effect_weekday",
    "peer_mean", "sdem_station_weights", "sdem_global_weights", "impute_warmup",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """40 users, two days, every kind."""
    at = tmp_path_factory.mktemp("events")
    begin = dt.datetime(2024, 1, 1)
    rows = [(i, begin + dt.timedelta(minutes=7 * i), i % 40, KINDS[i % 5], float(i % 17), "{}") for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.withColumn("ts", events["ts"].cast("timestamp_ntz")).write.parquet(f"{at}/events.parquet")
    return str(at)


def frame_joins(df) -> list[str]:
    """The joins of the plan that are over every hour of the panel."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Join [station#" in x and "pollutant#" in x.split("]")[0] and " ts#" in x.split("]")[0]]


@pytest.mark.parametrize("name", QUERIES)
def test_panel_frame_is_not_broadcast(spark, folder, name):
    found = __spark_entry__.queries()[name](spark, folder)
    before = frame_joins(found)
    found.collect()
    for joins in (before, frame_joins(found)):
        assert joins and not [x for x in joins if "Broadcast" in x]


def test_blocks_and_drawn_gaps_are_not_broadcast(spark):
    """Blocks copied to tiles, and gaps that grow out of one row, look small to the optimizer."""
    places = spark.createDataFrame([(f"S{i}", 10.0 + i / 100, 45.0, [1.0, 1.0]) for i in range(20)],
                                   "station string, lon double, lat double, moments array<double>")
    pairs = spatial_regression._pairs(places, places.select("station", "lon", "lat"), [], ["station", "moments"], 11.0)
    joins = [x for x in pairs._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [_gx#" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]
    observed = places.selectExpr("station", "timestamp'2024-01-01 00:00:00' as ts")
    mask = evaluation.inject_gaps(observed, 2, 7)
    joins = [x for x in mask._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [_index#" in x]
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_hours_of_a_week_are_not_copied_for_every_lag(spark):
    """A place and its hours are one row where places meet, and leave one row per hour of the target and bandwidth."""
    cells = spark.createDataFrame([(f"S{i}", 10.0 + i / 100, 45.0, h, [1.0 * h, 2.0]) for i in range(3) for h in range(1, 169)],
                                  "station string, lon double, lat double, time int, moments array<double>")
    parts = spatial_regression._timed_parts(cells, cells.drop("moments"), "time", [0.2, 0.45], leave_out=True)
    assert parts.count() == 2 * 3 * 168


def test_systems_solved_together_equal_one_by_one():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        x = rng.normal(size=(6, 3))
        if i % 5 == 0:
            x[:, 2] = x[:, 1]
        y, w = rng.normal(size=6), 0.0 if i == 7 else 1.0
        gram = w * (x.T @ x)
        rows.append(np.concatenate([gram[np.triu_indices(3)], w * (x.T @ y)]))
    rows[9][0] = np.nan
    for m, b in zip(rows, linalg.solve_many(np.array(rows)), strict=True):
        alone = linalg.solve_packed(m)
        assert (b is None) == (alone is None) and (b is None or np.allclose(b, alone, rtol=1e-12, atol=1e-14))


def test_panels_of_models_are_not_broadcast(spark, folder, monkeypatch):
    """What the models' panel and the scoring of methods write down on the way; every model query starts from them."""
    kind, seen = type(spark.range(1)), []
    write = kind.checkpoint

    def noted(self, *args, **options):
        seen.extend(frame_joins(self))
        return write(self, *args, **options)
    monkeypatch.setattr(kind, "checkpoint", noted)
    queries_models.complete_panel(Tables(spark, folder))
    assert seen and not [x for x in seen if "Broadcast" in x]
    seen.clear()
    __spark_entry__.queries()["evaluate_imputation"](spark, folder)
    assert seen and not [x for x in seen if "Broadcast" in x]
