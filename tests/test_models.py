"""Ordered operations, interpolation, imputation and models against brute force."""

import math

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import pytest

from stationweave.functions.sequences import dense_index, running_count, shifted
from stationweave.operators import effects, evaluation, interpolate, recursion, regression, rolling, spatial_regression, zones
from stationweave.operators import panel as P
from stationweave.plans import workflows
from tests.test_tables import points, zone_rows


@pytest.mark.parametrize("chunk", [7, 24, 5000])
def test_lags_leads_and_locf_do_not_depend_on_chunks(panel, panel_frame, chunk):
    got = shifted(panel, ["station"], "ts", {"l24": ("x", -24), "l1": ("x", -1), "f3": ("x", 3)}, chunk).toPandas()
    got = got.sort_values(["station", "ts"]).reset_index(drop=True)
    by = panel_frame.groupby("station")["x"]
    for name, k in (("l24", 24), ("l1", 1), ("f3", -3)):
        assert np.array_equal(got[name].astype(float), by.shift(k), equal_nan=True)
    filled = P.locf(panel, chunk_hours=chunk).toPandas().sort_values(["station", "ts"])["x"].to_numpy()
    want = panel_frame.groupby("station")["x"].transform(lambda s: s.ffill().bfill()).to_numpy()
    assert np.array_equal(filled, want)


def test_running_count_and_dense_index(panel, panel_frame):
    got = running_count(panel, ["station"], "ts", F.col("x").isNull(), "n", 10).toPandas().sort_values(["station", "ts"])
    want = panel_frame["x"].isna().groupby(panel_frame["station"]).cumsum()
    assert (got["n"].to_numpy() == want.to_numpy()).all()
    index = dense_index(panel.select("station").distinct(), "station", "i")
    assert sorted(r["i"] for r in index.collect()) == [0, 1, 2]


def test_effects_sum_to_zero_and_only_missing_change(panel, panel_frame):
    sums = effects.bucket_effects(panel).where("kind = 'hour'").groupBy("bucket").agg(F.sum("effect").alias("s"))
    assert all(abs(r["s"]) < 1e-9 for r in sums.collect())
    for method in effects.METHODS.values():
        done = method(panel).toPandas().sort_values(["station", "ts"])["x"].to_numpy()
        known = ~panel_frame["x"].isna().to_numpy()
        assert np.allclose(done[known], panel_frame["x"].to_numpy()[known])
        assert np.isfinite(done).sum() > known.sum()


def test_station_without_peers_stays_null(spark):
    df = spark.createDataFrame([("A", "pm", "2024-01-01 00:00:00", None), ("A", "pm", "2024-01-01 01:00:00", 1.0)],
                               "station string, pollutant string, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(str(r["x"]) for r in effects.sdem(df).collect()) == ["1.0", "None"]


def test_impute_covers_all_pollutants_and_keeps_other_rows(spark):
    rows = [("A", "hour", 0, None, 2.0), ("B", "hour", 0, 3.0, None), ("C", "hour", 0, 5.0, 4.0), ("A", "day", 0, None, None)]
    df = spark.createDataFrame(rows, "station string, averaging_time string, h int, pm double, no double").select(
        "station", "averaging_time", F.timestamp_seconds(F.col("h") * 3600).alias("begin_ts"), "pm", "no")
    got = {(r["station"], r["averaging_time"]): r for r in workflows.impute(df).collect()}
    assert got[("A", "day")]["pm"] is None and len(got) == 4
    assert got[("A", "hour")]["pm"] is None  # a station without any observation is left out
    with pytest.raises(ValueError):
        workflows.impute(df, "median")


def test_weights_equal_least_squares(panel):
    rows = effects.decomposition(panel)
    table = rows.na.drop("any", subset=["x", *effects.REGRESSORS]).toPandas()
    got = {r["station"]: r["weights"] for r in effects.fitted_weights(rows, ["station"]).collect()}
    for name, part in table.groupby("station"):
        want = np.linalg.lstsq(part[list(effects.REGRESSORS)].to_numpy(), part["x"].to_numpy(), rcond=None)[0]
        assert np.allclose(got[name], want, atol=1e-6)


def haversine(lon1, lat1, lon2, lat2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(a))


@pytest.mark.parametrize("nmax,maxdist,rows", [
    (None, None, 256), (3, None, 256), (None, 60.0, 256), (2, 60.0, 256), (None, None, 4), (3, None, 4), (2, 60.0, 4)])
def test_idw_brute_force(spark, monkeypatch, nmax, maxdist, rows):
    monkeypatch.setattr(interpolate, "STATION_ROWS", rows)  # small blocks split every crowded tile
    rng = np.random.default_rng(3)
    places = [(f"S{i:03d}", round(float(x), 3), round(float(y), 3)) for i, (x, y) in enumerate(rng.uniform([9, 44], [13, 47], (60, 2)))]
    places.append(("S999", 10.5, 45.5))
    vals = [(d, *p, float(rng.uniform(1, 9))) for d in ("d1", "d2") for p in places if rng.random() < 0.9 or p[0] == "S999"]
    df = spark.createDataFrame(vals, "date string, station string, lon double, lat double, value double")
    zs = zones.prepare_zones(zone_rows(spark, [("Z", 10.0, 45.0, 11.0, 46.0)]))
    cells = interpolate.grid_mask(interpolate.make_grid(zs, 0.25), zs)
    got = {(r["date"], r["i"], r["j"]): r for r in interpolate.idw(df, cells, 2.0, nmax, maxdist).collect()}
    assert len(got) == 32
    for (d, _, _), r in got.items():
        near = sorted((haversine(r["x"], r["y"], v[2], v[3]), v[4]) for v in vals if v[0] == d)
        near = [n for n in near if maxdist is None or n[0] <= maxdist][:nmax]
        if near and near[0][0] < 1e-9:
            want = near[0][1]
        else:
            want = sum(v / k ** 2 for k, v in near) / sum(1 / k ** 2 for k, _ in near) if near else None
        assert (r["value"] is None) == (want is None) and (want is None or r["value"] == pytest.approx(want, rel=1e-9))


def irls(x, y, steps=200):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(steps):
        mu = np.maximum(x @ b, 0.1 * y.mean())
        w = 1 / mu ** 2
        b = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
    return b


@pytest.fixture(scope="module")
def regression_rows(spark):
    rng = np.random.default_rng(8)
    frames = []
    for i in range(5):
        a, b = rng.uniform(1, 3, 150), rng.uniform(0, 2, 150)
        mu = 2 + (1 + 0.1 * i) * a + 0.5 * b
        y = rng.gamma(20, mu / 20)
        frames.append(pd.DataFrame({"station": f"S{i}", "lon": 9 + 0.2 * i, "lat": 45 + 0.1 * i, "a": a, "b": b, "y": y}))
    table = pd.concat(frames, ignore_index=True)
    return table, spark.createDataFrame(table).checkpoint()


def test_station_glm_matches_irls_and_mllib(regression_rows):
    table, df = regression_rows
    got = {r["station"]: r["coefficients"] for r in regression.gamma_glm(df, ["station"], "y", ["a", "b"], tolerance=1e-14).collect()}
    for name, part in table.groupby("station"):
        x = np.column_stack([np.ones(len(part)), part["a"], part["b"]])
        assert np.allclose(got[name], irls(x, part["y"].to_numpy()), atol=1e-5)
    one = df.where("station = 'S0'")
    model, _ = regression.pooled_glm(one, "y", ["a", "b"], "identity")
    assert np.allclose(got["S0"], regression.pooled_coefficients(model), atol=1e-4)
    log = regression.gamma_glm(one, [], "y", ["a", "b"], "log", tolerance=1e-14).first()["coefficients"]
    model, _ = regression.pooled_glm(one, "y", ["a", "b"], "log")
    assert np.allclose(log, regression.pooled_coefficients(model), atol=1e-4)


def test_station_glm_stops_with_an_empty_station(regression_rows, monkeypatch, recwarn):
    """A station without a usable row doesn't keep the passes going, and too few passes are told."""
    _, df = regression_rows
    passes = []
    solved = regression._solved
    monkeypatch.setattr(regression, "_solved", lambda *a: passes.append(1) or solved(*a))
    plain = {r["station"]: r["coefficients"] for r in regression.gamma_glm(df, ["station"], "y", ["a", "b"]).collect()}
    alone, passes[:] = len(passes), []
    empty = df.limit(3).withColumns({"station": F.lit("none"), "y": F.lit(None).cast("double")})
    with_empty = {r["station"]: r["coefficients"] for r in regression.gamma_glm(df.unionByName(empty), ["station"], "y", ["a", "b"]).collect()}
    assert len(passes) == alone
    assert with_empty.pop("none") is None and set(with_empty) == set(plain)
    assert all(list(with_empty[k]) == pytest.approx(list(plain[k])) for k in plain)
    assert not [w for w in recwarn if "still move" in str(w.message)]
    with pytest.warns(UserWarning, match="still move"):
        regression.gamma_glm(df, ["station"], "y", ["a", "b"], iterations=1, tolerance=1e-14)


def test_gwr_brute_force_and_wide_bandwidth(regression_rows):
    table, df = regression_rows
    places = df.select("station", "lon", "lat").distinct()
    x = np.column_stack([np.ones(len(table)), table["a"], table["b"]])
    y = table["y"].to_numpy()
    pooled = np.linalg.lstsq(x, y, rcond=None)[0]
    for r in spatial_regression.gwr(df, places, "y", ["a", "b"], 1e4).collect():
        assert np.allclose(r["coefficients"], pooled, atol=1e-6)
    for r in spatial_regression.gwr(df, places, "y", ["a", "b"], 0.3).collect():
        own = table[table["station"] == r["station"]].iloc[0]
        w = np.exp(-0.5 * ((table["lon"] - own["lon"]) ** 2 + (table["lat"] - own["lat"]) ** 2) / 0.09).to_numpy()
        want = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        assert np.allclose(r["coefficients"], want, atol=1e-8)


def test_gtwr_brute_force(regression_rows):
    table, df = regression_rows
    timed = df.withColumn("time", (F.pmod(F.monotonically_increasing_id(), F.lit(6)) + 1).cast("int")).checkpoint()
    t = timed.toPandas()
    got = spatial_regression.gtwr(timed, timed.select("station", "lon", "lat").distinct(), "y", ["a"], 0.4).where("time = 3").collect()
    assert len(got) == 5
    x, y = np.column_stack([np.ones(len(t)), t["a"]]), t["y"].to_numpy()
    for r in got:
        own = t[t["station"] == r["station"]].iloc[0]
        space, hours = np.hypot(t["lon"] - own["lon"], t["lat"] - own["lat"]), np.abs(t["time"] - 3)
        w = np.exp(-0.5 * (((np.sqrt(0.05 * space) + np.sqrt(0.95 * hours)) ** 2) / 0.4) ** 2).to_numpy()
        want = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        assert np.allclose(r["coefficients"], want, atol=1e-6)


def test_bandwidth_cv_brute_force(regression_rows):
    table, df = regression_rows
    got = {r["bandwidth"]: r["cv_error"] for r in spatial_regression.bandwidth_cv(df, "y", ["a"], [0.3, 1.0]).collect()}
    x, y = np.column_stack([np.ones(len(table)), table["a"]]), table["y"].to_numpy()
    for h, error in got.items():
        total = 0.0
        for name, part in table.groupby("station"):
            w = np.exp(-0.5 * ((table["lon"] - part["lon"].iloc[0]) ** 2 + (table["lat"] - part["lat"].iloc[0]) ** 2) / h ** 2)
            w = np.where(table["station"] == name, 0.0, w)
            b = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
            own = (table["station"] == name).to_numpy()
            total += ((y[own] - x[own] @ b) ** 2).sum()
        assert error == pytest.approx(total, rel=1e-8)


def _timed_table(df):
    timed = df.withColumn("time", (F.pmod(F.monotonically_increasing_id(), F.lit(6)) + 1).cast("int")).checkpoint()
    t = timed.toPandas()
    return timed, t, np.column_stack([np.ones(len(t)), t["a"]]), t["y"].to_numpy()


def test_timed_bandwidth_cv_brute_force(regression_rows):
    """Every (station, hour) cell under the coefficients that all other stations give it."""
    timed, t, x, y = _timed_table(regression_rows[1])
    got = {r["bandwidth"]: r["cv_error"] for r in spatial_regression.bandwidth_cv(timed, "y", ["a"], [0.3, 0.6], time="time").collect()}
    assert set(got) == {0.3, 0.6}
    for h, error in got.items():
        total = 0.0
        for (name, hour), part in t.groupby(["station", "time"]):
            space = np.hypot(t["lon"] - part["lon"].iloc[0], t["lat"] - part["lat"].iloc[0])
            d = (np.sqrt(0.05 * space) + np.sqrt(0.95 * np.abs(t["time"] - hour))) ** 2
            w = np.where(t["station"] == name, 0.0, np.exp(-0.5 * (d / h) ** 2))
            b = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
            own = ((t["station"] == name) & (t["time"] == hour)).to_numpy()
            total += ((y[own] - x[own] @ b) ** 2).sum()
        assert error == pytest.approx(total, rel=1e-7)


def test_bandwidth_search_narrows_around_the_best(regression_rows):
    _, df = regression_rows
    rounds = {}
    for r in spatial_regression.bandwidth_search(df, "y", ["a"], 0.1, 3.0, points=4, rounds=3).collect():
        rounds.setdefault(r["round"], []).append((r["bandwidth"], r["cv_error"]))
    low, high = 0.1, 3.0
    for n in (1, 2, 3):
        found = sorted(rounds[n])
        assert [h for h, _ in found] == pytest.approx([low * (high / low) ** (i / 3) for i in range(4)])
        alone = {r["bandwidth"]: r["cv_error"] for r in spatial_regression.bandwidth_cv(df, "y", ["a"], [h for h, _ in found]).collect()}
        assert [e for _, e in found] == pytest.approx([alone[h] for h, _ in found])
        best = min(range(4), key=lambda i: found[i][1])
        low, high = found[max(best - 1, 0)][0], found[min(best + 1, 3)][0]
    with pytest.raises(ValueError):
        spatial_regression.bandwidth_search(df, "y", ["a"], 1.0, 0.5)


def test_narrow_candidates_do_not_lose_stations(regression_rows):
    """Without any weight a station counts with its whole sum of squares, so a narrow bandwidth can't win by it."""
    table, df = regression_rows
    got = {r["bandwidth"]: r["cv_error"] for r in spatial_regression.bandwidth_cv(df, "y", ["a"], [1e-4, 1.0]).collect()}
    assert got[1e-4] == pytest.approx((table["y"] ** 2).sum()) and got[1.0] < got[1e-4]


@pytest.mark.parametrize("every", [1, 3])
def test_daily_coefficients_brute_force(regression_rows, every):
    table, df = regression_rows
    spread = table.assign(day=pd.Timestamp("2024-02-27") + pd.to_timedelta(table.groupby("station").cumcount() // 25, unit="D"))
    rows = df.sparkSession.createDataFrame(spread).withColumn("ts", F.col("day").cast("timestamp"))
    places = df.select("station", "lon", "lat").distinct()
    got = spatial_regression.daily_coefficients(rows, places, "y", ["a"], 0.3, window=2, every=every).collect()
    first, last = spread["day"].min() + pd.Timedelta(days=1), spread["day"].max() + pd.Timedelta(days=2)
    days = [d for d in pd.date_range(first, last) if (d - pd.Timestamp("1970-01-01")).days % every == 0]
    assert sorted({pd.Timestamp(r["day"]) for r in got}) == days and len(got) == 5 * len(days)
    for r in got:
        own = table[table["station"] == r["station"]].iloc[0]
        day = pd.Timestamp(r["day"])
        part = spread[(spread["day"] < day) & (spread["day"] >= day - pd.Timedelta(days=2))]
        x, y = np.column_stack([np.ones(len(part)), part["a"]]), part["y"].to_numpy()
        w = np.exp(-0.5 * ((part["lon"] - own["lon"]) ** 2 + (part["lat"] - own["lat"]) ** 2) / 0.09).to_numpy()
        assert np.allclose(r["coefficients"], np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y), atol=1e-8)


def test_local_fill_takes_the_newest_table(spark, panel, panel_frame):
    """Hours before the first table stay empty, and so does a station without any; the next hour's value is used where known."""
    rng = np.random.default_rng(4)
    days = ["2024-03-27", "2024-03-30", "2024-04-02"]
    made = [(s, d, [float(rng.uniform(5, 9)), float(rng.uniform(0.2, 0.6))]) for s in ("A001", "B002") for d in days]
    tables = spark.createDataFrame(made, "station string, d string, coefficients array<double>").select(
        "station", F.to_date("d").alias("day"), "coefficients")
    later = spark.createDataFrame([("A001", [1.0, 0.5, 0.4])], "station string, coefficients array<double>")
    rows = P.add_leads(P.add_lags(panel, "x", ["station"], lags=(1,)), "x", ["station"], leads=(1,)).withColumn("day", F.to_date("ts"))
    forward = (later, F.array(F.lit(1.0), F.col("x_lag1"), F.col("x_lead1")), F.col("x_lead1").isNotNull())
    got = recursion.local_fill(rows, ["station"], "ts", "x", F.array(F.lit(1.0), F.col("x_lag1")), {1: 1}, tables,
                               at="day", newest=True, forward=forward).toPandas()
    assert len(got) == len(panel_frame)
    by = {}
    for s, d, b in made:
        by.setdefault(s, []).append((pd.Timestamp(d), b))
    for name, part in panel_frame.groupby("station"):
        raw, hours = part["x"].to_numpy(), part["ts"].to_list()
        want = raw.copy()
        for i in range(len(want)):
            if np.isnan(want[i]) and i and not np.isnan(want[i - 1]):
                old = [b for d, b in by.get(name, []) if d <= hours[i].normalize()]
                if name == "A001" and i + 1 < len(raw) and not np.isnan(raw[i + 1]):
                    want[i] = 1.0 + 0.5 * want[i - 1] + 0.4 * raw[i + 1]
                elif old:
                    want[i] = old[-1][0] + old[-1][1] * want[i - 1]
        mine = got[got["station"] == name].sort_values("ts")["x"].to_numpy(dtype=float)
        assert np.allclose(mine, want, equal_nan=True)
        assert np.isnan(want).sum() < np.isnan(raw).sum() or name == "C003"


def test_recursive_fill_brute_force(panel, panel_frame):
    rows = P.add_lags(panel, "x", ["station"], lags=(1, 2))
    x = F.array(F.lit(1.0), F.col("x_lag1"), F.col("x_lag2"))
    got = recursion.recursive_fill(rows, ["station"], "ts", "x", x, {1: 1, 2: 2}, F.array(F.lit(0.5), F.lit(0.7), F.lit(0.2)))
    got = got.toPandas().sort_values(["station", "ts"])
    for name, part in panel_frame.groupby("station"):
        want = part["x"].to_numpy().copy()
        for i in range(2, len(want)):
            if np.isnan(want[i]):
                want[i] = 0.5 + 0.7 * want[i - 1] + 0.2 * want[i - 2]
        mine = got[got["station"] == name]["x"].to_numpy(dtype=float)
        assert np.allclose(mine, want, equal_nan=True)


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_lockstep_equals_a_loop_over_cells(rows):
    """Runs of many lengths, rows of two widths, NULL rows and entries, runs cut at every place."""
    import pyarrow as pa
    rng = np.random.default_rng(rows)
    cells = []
    for run in range(12):
        hours = np.flatnonzero(rng.random(60) < 0.6) + 100 * run
        for h in hours.tolist():
            x = [1.0, *[None if rng.random() < 0.7 else float(rng.normal()) for _ in range(3)], float(rng.normal())]
            beta = [0.3, 0.5, -0.2, 0.4, 0.1]
            if h % 5 == 0:
                x, beta = [*x, 2.0], [*beta, 0.05]
            cells.append((run, h, None if rng.random() < 0.05 else x, None if rng.random() < 0.05 else beta))
    want, filled, owner = [], {}, None
    for run, h, x, beta in cells:
        if run != owner:
            owner, filled = run, {}
        guess = math.nan
        if x is not None and beta is not None:
            full = [filled.get(h - lag, math.nan) if x[at] is None else x[at] for at, lag in ((1, 1), (2, 2), (3, 5))]
            guess = float(np.dot([x[0], *full, *x[4:]], beta))
            guess = 0.01 if guess <= 0 else guess
            if not math.isnan(guess):
                filled[h] = guess
        want.append(guess)
    runs, hours, xs, betas = zip(*cells)
    table = pa.table({"run": pa.array(runs), "hour": pa.array(hours), "x": pa.array(xs, pa.list_(pa.float64())),
                      "b": pa.array(betas, pa.list_(pa.float64()))})
    got, owner, past = [], None, (np.zeros(0, dtype=np.int64), np.zeros(0))
    for part in recursion._gathered(iter(table.to_batches(max_chunksize=rows)), rows):
        run, hour = part.column("run").to_numpy(), part.column("hour").to_numpy()
        past = past if run[0] == owner else (past[0][:0], past[1][:0])
        x, beta, usable = recursion._model_rows(part.column("x"), part.column("b"))
        made = recursion._lockstep(x, beta, usable, np.unique(run, return_inverse=True)[1], hour,
                                   {1: 1, 2: 2, 5: 3}, recursion._dot, 0.01, past)
        got += made.tolist()
        past = past if run[-1] == run[0] else (past[0][:0], past[1][:0])
        last = run == run[-1]
        past, owner = (np.concatenate([past[0], hour[last]]), np.concatenate([past[1], made[last]])), run[-1]
    assert np.allclose(got, want, equal_nan=True) and not all(math.isnan(v) for v in got)


def test_runs_that_go_on_in_the_next_batch(panel, monkeypatch):
    """Batches of one row give what one batch of all rows gives."""
    rows = P.add_lags(panel, "x", ["station"], lags=(1, 2))
    x = F.array(F.lit(1.0), F.col("x_lag1"), F.col("x_lag2"))

    def filled():
        got = recursion.recursive_fill(rows, ["station"], "ts", "x", x, {1: 1, 2: 2}, F.array(F.lit(0.5), F.lit(0.7), F.lit(0.2)))
        return sorted(map(tuple, got.collect()))
    whole = filled()
    monkeypatch.setattr(recursion, "LOCKSTEP_ROWS", 1)
    panel.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert filled() == whole
    finally:
        panel.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_forward_model_needs_every_lead(panel):
    rows = P.panel_features(panel.withColumn("z", F.col("x")), "x", ["z"], ["station"])
    flags = rows.select(recursion.choose_forward_model("x", ["z"]).alias("f"), *[F.col(c) for c in regression.lead_names("x")]).toPandas()
    assert (flags["f"] == flags[regression.lead_names("x")].notna().all(axis=1)).all()


def test_masks_stay_inside_stations_and_repeat(panel):
    mask = evaluation.inject_gaps(panel, 4, 3)
    again = evaluation.inject_gaps(panel, 4, 3)
    assert sorted(map(tuple, mask.collect())) == sorted(map(tuple, again.collect()))
    assert mask.join(panel, ["station", "ts"], "left_anti").count() == 0
    blanked = evaluation.masked_panel(panel, mask, 4)
    assert blanked.count() == 4 * panel.count()
    assert blanked.where("truth is not null and x is not null").count() == 0


def test_scores(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", None, 1.0), ("c", 2.0, 2.5)], "k string, truth double, estimate double")
    got = {r["k"]: r for r in evaluation.score(df, ["k"]).collect()}
    assert (got["m"]["n"], got["m"]["r2"], got["m"]["mae"]) == (2, 0.5, 0.5) and got["m"]["rmse"] == pytest.approx(math.sqrt(0.5))
    assert got["c"]["r2"] is None


def test_rolling_refit_fills_everything(spark, panel, panel_frame):
    base = panel.drop("pollutant").withColumn("z", F.hour("ts") + 1.0)
    done = rolling.rolling_refit(base, "x", ["z"], warm_days=8, lags=(1, 24))
    table = done.toPandas().sort_values(["station", "ts"])
    late = table["ts"] >= pd.Timestamp("2024-04-02")
    assert table[late]["x"].notna().all() and len(table) == len(panel_frame)
    known = panel_frame["x"].notna().to_numpy()
    assert np.allclose(table["x"].to_numpy(dtype=float)[known], panel_frame["x"].to_numpy()[known])


def test_rolling_refit_equals_a_direct_fit(spark, panel, panel_frame, monkeypatch):
    """The first two days by hand; every later day reads a bounded number of folders and has a plan of the same size."""
    seen = []
    real = rolling.recursive_fill
    monkeypatch.setattr(rolling, "recursive_fill", lambda df, *a, **k: seen.append(df) or real(df, *a, **k))
    base = panel.drop("pollutant").withColumn("z", F.hour("ts") + 1.0)
    done = rolling.rolling_refit(base, "x", ["z"], warm_days=7, lags=(1, 24), train_hours=48)
    got = done.toPandas().set_index(["station", "ts"])["x"].sort_index()
    warmed = effects.warm_up(base, 24 * 7, "x", "ts", ()).toPandas().sort_values(["station", "ts"]).reset_index(drop=True)
    warmed["x"] = warmed["x"].astype(float)
    for day in (pd.Timestamp("2024-04-01"), pd.Timestamp("2024-04-02")):
        lagged = warmed.assign(l1=warmed.groupby("station")["x"].shift(1), l24=warmed.groupby("station")["x"].shift(24))
        week = lagged[(lagged["ts"] < day) & (lagged["ts"] >= day - pd.Timedelta(hours=48))].dropna()
        x = np.column_stack([np.ones(len(week)), week["l1"], week["l24"], week["z"]])
        b = irls(x, week["x"].to_numpy())
        for i in warmed.index[(warmed["ts"] >= day) & (warmed["ts"] < day + pd.Timedelta(days=1)) & warmed["x"].isna()]:
            warmed.loc[i, "x"] = b @ [1, warmed.loc[i - 1, "x"], warmed.loc[i - 24, "x"], warmed.loc[i, "z"]]
    until = warmed[warmed["ts"] < pd.Timestamp("2024-04-03")].set_index(["station", "ts"])["x"].sort_index()
    assert np.allclose(got.loc[until.index].astype(float), until, atol=2e-3)
    assert len(seen) == 3 and len({len(d._jdf.queryExecution().optimizedPlan().toString().split("\n")) for d in seen}) == 1
    folders = [{f.rsplit("/", 2)[1] for f in d.inputFiles()} for d in seen]
    assert [len(f) for f in folders] == [4, 4, 4] and folders[0] != folders[2]


def test_rolling_refit_with_terms(spark, panel, panel_frame):
    base = panel.drop("pollutant").withColumns({
        "z": F.hour("ts") + 1.0, "time": F.hour("ts") + 24.0 * F.dayofweek("ts"),
        "type": F.when(F.col("station") == "A001", "a").otherwise("b")})
    from stationweave.operators.smooth import Smooth
    done = rolling.rolling_refit(base, "x", ["z"], warm_days=9, lags=(1, 24), link="log", factor="type",
                                 smooths=[Smooth("time", (24.0, 90.0, 192.0))], iterations=2)
    table = done.toPandas().sort_values(["station", "ts"])
    assert done.columns == base.columns and len(table) == len(panel_frame) and table["x"].notna().mean() > 0.99
    filled = table["x"].to_numpy(dtype=float)[panel_frame["x"].isna().to_numpy()]
    assert (filled[~np.isnan(filled)] > 0).all()
    with pytest.raises(ValueError):
        rolling.rolling_refit(base, "x", ["z"], smooths=[Smooth("z", (0.0, 1.0, 2.0), by_station=True)])
    assert rolling.rolling_refit(base.limit(0), "x", ["z"]).count() == 0


def test_forest_scan_equals_model(regression_rows, monkeypatch):
    _, df = regression_rows
    model, names = regression.forest(df, "y", ["a", "b"], trees=3, depth=3)
    predict = recursion.forest_predictor(regression.forest_nodes(model))
    from pyspark.ml.linalg import Vectors
    rows = [[1.1, 0.3], [2.9, 1.9], [2.0, 1.0]]
    want = [model.predict(Vectors.dense(x)) for x in rows]
    assert predict(np.array(rows), None) == pytest.approx(want)
    monkeypatch.setattr(recursion, "WALK_CELLS", 4)  # one tree at a time
    assert predict(np.array(rows), None) == pytest.approx(want)


def test_nearest_stations_on_the_whole_globe(spark, monkeypatch):
    """Ring search over the date line, at the poles, between crowds and in empty oceans; and how many outlines it pairs."""
    monkeypatch.setattr(interpolate, "STATION_ROWS", 4)
    rng = np.random.default_rng(6)
    spots = [*rng.uniform([-180, -88], [180, 88], (60, 2)), *rng.uniform([9, 45], [11, 46], (60, 2)),
             *rng.uniform([178, -20], [180, -18], (15, 2)), *rng.uniform([-180, -20], [-178, -18], (15, 2))]
    places = [(f"S{i:03d}", round(float(x), 4), round(float(y), 4)) for i, (x, y) in enumerate(spots)]
    points = [(i, i, round(float(x), 3), round(float(y), 3)) for i, (x, y) in enumerate(
        [(179.95, -19.0), (-179.95, -19.0), (0.0, 89.5), (120.0, -89.9), (10.0, 45.5), (-150.0, 0.0), (-30.0, -50.0), (9.0, 45.0)])]
    stations = spark.createDataFrame(places, "station string, lon double, lat double")
    cells = spark.createDataFrame([(16 * i, 16 * j, x, y, 0.0, 0.0, 1.0) for i, j, x, y in points],
                                  "i long, j long, x double, y double, gx0 double, gy0 double, step double")
    for nmax, maxdist in ((1, None), (5, None), (30, None), (400, None), (5, 900.0)):
        got = interpolate.neighbours(stations, cells, nmax=nmax, maxdist=maxdist).collect()
        for i, _, x, y in points:
            near = sorted((haversine(x, y, lon, lat), s) for s, lon, lat in places)
            near = [n for n in near if maxdist is None or n[0] <= maxdist][:nmax]
            mine = sorted((r["rank"], r["km"], r["station"]) for r in got if r["i"] == 16 * i)
            assert len(mine) == len(near) and all(a[1] == pytest.approx(b[0], abs=1e-6) for a, b in zip(mine, near))
    # Stations far away don't add to what is paired with a crowd's own block.
    def paired(extra):
        more = spark.createDataFrame([*places[60:120], *extra], "station string, lon double, lat double")
        sources = interpolate.source_blocks(more, [], "station", ["station"], interpolate.TILE, 4)
        named = sources.withColumn("block", F.concat_ws(":", F.floor("lon0"), F.floor("lat0"), F.col("part")))
        return interpolate._near_blocks(named, interpolate._target_blocks(cells.where("i = 64")), [], 3, None).count()
    far = [(f"F{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([60, -60], [170, 30], (500, 2)))]
    assert 0 < paired([]) == paired(far)


def test_idw_of_many_dates_and_places_that_move(spark, monkeypatch):
    """Slices of dates, stations that miss dates or have another place on some, and no dates at all."""
    monkeypatch.setattr(interpolate, "SLICE", 3)
    rng = np.random.default_rng(9)
    vals = [(f"d{d:02d}", f"S{i}", 10.0 + 0.1 * i + (0.05 if d % 4 == 0 else 0.0), 45.0 + 0.07 * i, float(rng.uniform(1, 9)))
            for d in range(11) for i in range(9) if rng.random() < 0.7 or d == 5]
    vals.append(("d05", "S9", 10.5, 45.5, 3.25))
    df = spark.createDataFrame(vals, "date string, station string, lon double, lat double, value double")
    zs = zones.prepare_zones(zone_rows(spark, [("Z", 10.0, 45.0, 11.0, 46.0)]))
    cells = interpolate.grid_mask(interpolate.make_grid(zs, 0.25), zs)
    for maxdist in (None, 40.0):
        got = {(r["date"], r["i"], r["j"]): r for r in interpolate.idw(df, cells, 2.0, None, maxdist).collect()}
        assert len(got) == 11 * 16
        for (d, _, _), r in got.items():
            near = [(haversine(r["x"], r["y"], v[2], v[3]), v[4]) for v in vals if v[0] == d]
            near = [n for n in near if maxdist is None or n[0] <= maxdist]
            same = [v for k, v in near if k < 1e-9]
            want = same[0] if same else (sum(v / k ** 2 for k, v in near) / sum(1 / k ** 2 for k, _ in near) if near else None)
            assert (r["value"] is None) == (want is None) and (want is None or r["value"] == pytest.approx(want, rel=1e-9))
    one = interpolate.idw(df.where("date = 'd05'").drop("date"), cells, keys=()).collect()
    assert len(one) == 16 and all(r["value"] is not None for r in one)
