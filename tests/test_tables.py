"""Contracts, filters, geometry and aggregation on small frames."""

import datetime as dt

import numpy as np
import pyspark.sql.functions as F
import pytest

from stationweave.functions import columns as C
from stationweave.functions import geometry
from stationweave.functions.quantiles import grouped_quantiles
from stationweave.model import infer_pollutants, is_measurement_table, validate_contract
from stationweave.operators import aggregate, maps, selection, stations, summary, zones
from stationweave.plans import workflows
from stationweave.sources import readers, writers

SCHEMA = "station string, pollutant string, concentration double, averaging_time string, begin_ts timestamp, end_ts timestamp"


def obs(spark, rows):
    full = []
    for station, pollutant, value, begin in rows:
        b = dt.datetime.fromisoformat(begin)
        full.append((station, pollutant, value, "hour", b, b + dt.timedelta(hours=1)))
    return spark.createDataFrame(full, SCHEMA)


def test_contract(spark):
    long = obs(spark, [("A", "pm", 1.0, "2024-01-01")])
    assert validate_contract(long) == "long"
    wide = aggregate.pivot_measurements(long, ["pm"])
    assert validate_contract(wide) == "wide" and infer_pollutants(wide) == ["pm"]
    assert not is_measurement_table(long.drop("begin_ts"))
    with pytest.raises(ValueError):
        validate_contract(spark.range(1))


def test_pivot_null_duplicate_poisons(spark):
    df = obs(spark, [("A", "pm", 1.0, "2024-01-01"), ("A", "pm", None, "2024-01-01"), ("A", "no", 4.0, "2024-01-01"),
                     ("A", "no", 6.0, "2024-01-01")])
    row = aggregate.pivot_measurements(df, ["pm", "no", "o3"]).first()
    assert row["pm"] is None and row["no"] == 5.0 and row["o3"] is None


def test_pivot_then_longer_is_identity(spark):
    df = obs(spark, [("A", "pm", 1.0, "2024-01-01"), ("B", "no", 2.0, "2024-01-02")])
    back = aggregate.pivot_longer(aggregate.pivot_measurements(df, ["pm", "no"]), ["pm", "no"]).na.drop()
    assert sorted((r["station"], r["pollutant"], r["concentration"]) for r in back.collect()) == [
        ("A", "pm", 1.0), ("B", "no", 2.0)]


def test_local_periods_cross_midnight_and_dst(spark):
    df = obs(spark, [("A", "pm", 1.0, "2024-01-31 23:30:00"), ("A", "pm", 3.0, "2024-07-01 22:30:00"),
                     ("A", "pm", 9.0, "2024-12-31 23:00:00")])
    got = {str(r["date"]): r["mean"] for r in aggregate.time_aggregate(df, "daily", ["mean"]).collect()}
    assert got == {"2024-02-01": 1.0, "2024-07-02": 3.0, "2025-01-01": 9.0}


def test_statistics_edge_cases(spark):
    df = obs(spark, [("A", "pm", 4.0, "2024-01-02"), ("B", "pm", None, "2024-01-02")])
    rows = {r["station"]: r for r in aggregate.time_aggregate(df, "monthly", ["sd", "median", "max"]).collect()}
    assert rows["A"]["sd"] is None and rows["A"]["median"] == 4.0
    assert rows["B"]["median"] is None and rows["B"]["max"] is None
    with pytest.raises(ValueError):
        aggregate.time_aggregate(df, "monthly", ["mode"])
    with pytest.raises(ValueError):
        aggregate.time_aggregate(df, "fortnightly")


def test_wide_columns_are_named_by_function(spark):
    df = obs(spark, [("A", "pm", 1.0, "2024-01-02"), ("A", "no", 7.0, "2024-01-02"), ("A", "pm", 3.0, "2024-01-03")])
    names = ["quantile_0.5", "max"]
    row = aggregate.time_aggregate_wide(aggregate.time_aggregate(df, "monthly", names), ["pm", "no"], names).first()
    assert row["pm_quantile_0.5"] == 2.0 and row["pm_max"] == 3.0 and row["no_max"] == 7.0


@pytest.mark.parametrize("max_distinct", [10 ** 6, 40])
def test_quantiles_exact_for_small_and_dominant_groups(spark, max_distinct):
    rng = np.random.default_rng(1)
    big, small = np.round(rng.lognormal(0, 2, 3000), 2), rng.normal(size=17)
    rows = [("big", float(v)) for v in big] + [("small", float(v)) for v in small] + [("big", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r["k"]: r["quantiles"] for r in grouped_quantiles(df, ["k"], "v", probs, max_distinct, slices=16).collect()}
    assert np.allclose(got["big"], np.quantile(big, probs)) and np.allclose(got["small"], np.quantile(small, probs))


def test_summary_minima_differ_and_correlation_without_variance(spark):
    df = obs(spark, [("A", "pm", -1.0, "2024-01-01 00:00:00"), ("A", "pm", 2.0, "2024-01-01 01:00:00"),
                     ("A", "no", 5.0, "2024-01-01 00:00:00"), ("A", "no", 5.0, "2024-01-01 01:00:00")])
    wide = aggregate.pivot_measurements(df, ["pm", "no"])
    assert {r["pollutant"]: r["min"] for r in summary.summary_global(wide, ["pm", "no"]).collect()} == {"pm": 2.0, "no": 5.0}
    assert {r["pollutant"]: r["min"] for r in summary.summary_by_station(wide, ["pm", "no"]).collect()}["pm"] == -1.0
    corr = {(r[1], r[2]): r[3] for r in summary.corr_matrix(wide, ["pm", "no"]).collect()}
    assert corr[("pm", "no")] is None and corr[("pm", "pm")] == 1.0 and corr[("no", "no")] is None


@pytest.mark.parametrize("chunk", [3, 24, 1000])
def test_gaps_do_not_depend_on_chunks(panel, panel_frame, chunk):
    got = {r["station"]: r for r in summary.gap_length(panel, chunk_hours=chunk).collect()}
    for name, rows in panel_frame.groupby("station"):
        x = rows["x"].to_numpy().copy()
        x[[0, -1]] = 0
        gaps = np.diff(np.flatnonzero(~np.isnan(x)))
        assert got[name]["max_gap"] == gaps.max() and got[name]["median_gap"] == np.median(gaps)
        assert got[name]["mean_gap"] == pytest.approx(gaps.mean(), abs=1e-3)
        assert got[name]["sd_gap"] == pytest.approx(gaps.std(ddof=1), abs=1e-3)


def test_date_filter_end_is_its_first_instant(spark):
    df = obs(spark, [("A", "pm", 1.0, "2024-01-05 10:00:00"), ("A", "pm", 2.0, "2024-01-06 10:00:00")])
    assert selection.filter_dates(df, "2024-01-05", "2024-01-06").count() == 1
    assert selection.filter_dates(df, "2024-01-05", "2024-01-06", end_inclusive=True).count() == 2


def test_availability_policy(spark):
    df = obs(spark, [("A", "pm", 1.0, "2024-01-05")])
    with pytest.warns(UserWarning):
        assert selection.check_availability(df, "pollutant", ["pm", "o3"]) == ["pm"]
    with pytest.raises(ValueError):
        selection.check_availability(df, "pollutant", ["o3"])


def points(spark, rows):
    return spark.createDataFrame(rows, "station string, lon double, lat double")


def zone_rows(spark, boxes, level=2):
    df = spark.createDataFrame(boxes, "zone_id string, x0 double, y0 double, x1 double, y1 double")
    return df.select(F.lit(level).alias("level"), "zone_id", F.col("zone_id").alias("zone_name"),
                     geometry.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("rings"))


def test_polygon_concave_and_hole(spark):
    pts = points(spark, [("in", 1.0, 1.0), ("notch", 2.0, 3.5), ("out", 9.0, 9.0)])
    concave = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    assert [r["station"] for r in zones.select_in_polygon(pts, concave).collect()] == ["in"]
    holed = F.array(geometry.ring_literal([(0, 0), (4, 0), (4, 4), (0, 4)]), geometry.ring_literal([(0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2)]))
    got = pts.select("station", geometry.contains(geometry.edges(holed), F.col("lon"), F.col("lat")).alias("c")).collect()
    assert {r["station"]: r["c"] for r in got} == {"in": False, "notch": True, "out": False}


def test_shared_border_belongs_to_one_zone_and_overlap_takes_smallest(spark):
    pts = points(spark, [("border", 1.0, 0.5), ("both", 0.5, 0.5), ("none", 7.0, 7.0)])
    zs = zone_rows(spark, [("Z1", 0.0, 0.0, 1.0, 1.0), ("Z2", 1.0, 0.0, 2.0, 1.0), ("Z0", 0.0, 0.0, 0.75, 1.0)])
    got = {r["station"]: r["zone_id"] for r in zones.point_in_zone(pts, zs, ["station"]).collect()}
    assert got == {"border": "Z2", "both": "Z0", "none": None}


def test_hull_and_wkt(spark):
    pts = points(spark, [("edge", 1.0, 0.0), ("in", 1.0, 0.5), ("out", 3.0, 3.0)])
    got = sorted(r["station"] for r in zones.select_in_hull(pts, [(0, 0), (2, 0), (1, 2), (1, 0.5)]).collect())
    assert got == ["edge", "in"]
    with pytest.raises(ValueError):
        geometry.convex_hull([(0, 0), (1, 1), (2, 2)])
    text = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (0.2 0.1, 0.4 0.1, 0.4 0.2, 0.2 0.1)), ((5 5, 6 5, 6 6, 5 5)))"
    rings = spark.createDataFrame([(text,)], "wkt string").select(geometry.from_wkt(F.col("wkt")).alias("r")).first()["r"]
    assert [len(r) for r in rings] == [4, 4, 4] and rings[2][1]["x"] == 6.0


def test_overlap_area_of_triangles():
    def edge(points_):
        return np.array([[*a, *b] for a, b in zip(points_, points_[1:] + points_[:1], strict=True)], float)
    square, tri = edge([(0, 0), (2, 0), (2, 2), (0, 2)]), edge([(1, 1), (3, 1), (1, 3)])
    assert geometry._overlap(square, tri) == pytest.approx(1.0)
    assert geometry._overlap(square, square) == pytest.approx(4.0)
    assert geometry._overlap(square, edge([(5, 5), (6, 5), (5, 6)])) == 0.0


def _ring_area(ring):
    """Area in km2 of a ring after the equal-area map, by the shoelace."""
    x, y = np.radians([p[0] for p in ring]), np.sin(np.radians([p[1] for p in ring]))
    return abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 * geometry.EARTH_RADIUS_KM ** 2


def _zones_of_rings(spark, rings):
    rows = [(name, [[(float(x), float(y)) for x, y in [*ring, ring[0]]] for ring in parts]) for name, parts in rings]
    return spark.createDataFrame(rows, "zone_id string, rings array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize("slab_edges", [1, 3, 256])
def test_overlap_by_slabs_equals_the_whole_outlines(spark, slab_edges):
    rng = np.random.default_rng(3)

    def star(cx, cy, n=23):
        turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
        far = rng.uniform(0.2, 1.3, n)
        return list(zip(cx + far * np.cos(turn), cy + far * np.sin(turn), strict=True))
    # The third coarse zone has a hole; two are equal, so the smaller id wins.
    fine = [(f"F{i}", [star(rng.uniform(-1, 3), rng.uniform(-1, 3))]) for i in range(6)]
    coarse = [("C0", [star(0, 0)]), ("C1", [star(2, 1), [(6, 6), (7, 6), (7, 7)]]),
              ("C2", [[(-2, -2), (4, -2), (4, 4), (-2, 4)], [(0, 0), (1.5, 0), (1.5, 1.5), (0, 1.5)]])]
    coarse.append(("C3", coarse[2][1]))
    got = {r["zone_id"]: (r["parent_id"], r["area_km2"]) for r in zones.zone_largest_overlap(
        _zones_of_rings(spark, fine), _zones_of_rings(spark, coarse), slab_edges=slab_edges).collect()}

    def flat(parts):
        return np.array([[np.radians(a[0]), np.sin(np.radians(a[1])), np.radians(b[0]), np.sin(np.radians(b[1]))]
                         for ring in parts for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)])
    for name, parts in fine:
        areas = [(geometry._overlap(flat(parts), flat(other)) * geometry.EARTH_RADIUS_KM ** 2, c) for c, other in coarse]
        best = max(a for a, _ in areas)
        assert got[name][0] == min(c for a, c in areas if a > best - 1e-7) and got[name][1] == pytest.approx(best, abs=1e-6)


def test_overlap_of_an_outline_of_30000_edges(spark, monkeypatch):
    """A fine outline and two halves: areas by the shoelace; no slab holds more than a small part of the edges."""
    n = 30_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = 0.8 + 0.05 * np.sin(60 * turn)
    ring = list(zip(0.9 + far * np.cos(turn), 45.3 + far * np.sin(turn), strict=True))
    fine = _zones_of_rings(spark, [("round", [ring])])
    coarse = _zones_of_rings(spark, [("all", [[(-3, 40), (5, 40), (5, 50), (-3, 50)]]), ("west", [[(-3, 40), (0.5, 40), (0.5, 50), (-3, 50)]])])
    row = zones.zone_largest_overlap(fine, coarse).first()
    assert row["parent_id"] == "all" and row["area_km2"] == pytest.approx(_ring_area(ring), rel=1e-9)
    edges = zones._column_edges(fine, "zone_id", 1.0)
    grid = edges.groupBy("_cx").agg(F.ceil(F.count(F.lit(1)) / 256).alias("_slabs"))
    held = zones._slab_edges(edges, grid, "zone_id", 1.0).agg(F.max(F.size("_zone_id") / 4), F.sum(F.size("_zone_id") / 4)).first()
    # The outline turns back at its sides, where a slab holds most edges.
    assert held[0] < n / 10 and held[1] < 1.1 * n


def test_bounds_warn_when_inner_is_not_finer(spark):
    zs = zone_rows(spark, [("XX1", 0.0, 0.0, 1.0, 1.0)], 1)
    with pytest.warns(UserWarning):
        assert maps.zone_bounds(zs, "NUTS1", ["XX1"], "NUTS0").count() == 1


def test_modal_coordinate_and_null_key_join(spark):
    rows = [("S", None, "n", 1.0, 1.0, "a"), ("S", None, "n", 1.0, 1.0, "b"), ("S", None, "n", 2.0, 2.0, "c")]
    sp = spark.createDataFrame(rows, "station string, nat_code string, station_name string, longitude double, latitude double, sampling_point_id string")
    fixed = stations.attach_modal_coordinates(sp, stations.modal_coordinate(sp))
    assert {(r["longitude"], r["latitude"]) for r in fixed.collect()} == {(1.0, 1.0)} and fixed.count() == 3


def test_scalar_helpers(spark):
    row = spark.createDataFrame([("NUTS3", "LAU", "Greece", "http://x/pollutant/6001", '"MILANO\nVIA"', "PM - recommended unit: ug")],
                                "a string, b string, c string, d string, e string, f string").select(
        C.zone_level_code("a"), C.zone_level_code("b"), C.country_to_iso("c"), C.vocabulary_code("d"),
        C.clean_station_name("e"), C.vocabulary_unit("f")).first()
    assert tuple(row) == (3, 4, "EL", 6001, "Milanovia", "ug")


def test_text_round_trips(spark, tmp_path):
    df = obs(spark, [("A", "pm", 1.5, "2024-01-01"), ("B", "no", None, "2024-01-02"), ("B", "pm", 2.0, "2024-01-02")])
    wide = aggregate.pivot_measurements(df, ["pm", "no"])
    want = sorted(map(str, wide.collect()))
    writers.export_csv(wide, str(tmp_path / "a.csv"))
    writers.export_txt(wide, str(tmp_path / "a.txt"))
    for back in (readers.import_csv(spark, str(tmp_path / "a.csv")), readers.import_txt(spark, str(tmp_path / "a.txt"))):
        assert back.pollutants == ("pm", "no") and sorted(map(str, back.df.collect())) == want
    with pytest.raises(ValueError):
        readers.import_csv(spark, str(tmp_path / "a.txt"))


def test_geojson_zones(spark, tmp_path):
    (tmp_path / "z.json").write_text(
        '{"properties": {"LEVL_CODE": "1", "NUTS_ID": "XX1", "NAME_LATN": "One", "CNTR_CODE": "XX"}, '
        '"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}\n'
        '{"properties": {"LAU_ID": "L1", "LAU_NAME": "Town", "CNTR_CODE": "XX"}, '
        '"geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}\n')
    got = {r["zone_id"]: r for r in readers.scan_zones(spark, str(tmp_path / "z.json")).collect()}
    assert got["XX1"]["level"] == 1 and len(got["XX1"]["rings"]) == 1
    assert got["L1"]["level"] == 4 and len(got["L1"]["rings"]) == 2


def test_request_flow(spark):
    df = obs(spark, [("A", "pm", 1.0, "2024-01-01"), ("B", "pm", 2.0, "2024-01-01"), ("A", "pm", 3.0, "2023-01-01")])
    master = spark.createDataFrame(
        [("A", "Ay", "pm", 0.5, 0.5, "Italy", "IT", "XX1"), ("B", "Be", "pm", 5.0, 5.0, "France", "FR", "XX2")],
        "station string, station_name string, pollutant string, longitude double, latitude double, country string, iso string, nuts1_id string")
    zs = zone_rows(spark, [("XX1", 0.0, 0.0, 1.0, 1.0), ("XX2", 4.0, 4.0, 6.0, 6.0)], 1)
    by_zone = workflows.get_measurements(df, master, ["pm"], 2024, 2024, zs, "NUTS1", ["XX1"])
    assert [(r["station"], r["station_name"], r["pm"]) for r in by_zone.df.collect()] == [("A", "Ay", 1.0)]
    by_box = workflows.get_measurements(df, master, ["pm"], 2024, 2024, quadrant=[(4.0, 4.0), (6.0, 6.0)])
    assert [r["station"] for r in by_box.df.collect()] == ["B"]
    aggregated = workflows.time_aggregate(by_zone, "daily", ["mean"])
    cells = workflows.idw_map_data(aggregated, master.withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")}), "pm", step=0.25)
    assert {round(r["value"], 6) for r in cells.collect()} == {1.0} and cells.count() == 16
    assert set(workflows.summarise(by_zone)) >= {"counters", "summary", "gap_length"}
    with pytest.raises(ValueError):
        workflows.get_measurements(df, master, ["pm"], 2024, "2024-02-01", zs, "NUTS1", ["XX1"])
    with pytest.raises(ValueError):
        workflows.get_measurements(df, master, ["pm"], 2024, 2024)


def test_distance_limit_over_the_date_line(spark):
    """A grid point and a station 22 km apart on both sides of 180 degrees see each other."""
    from stationweave.operators import interpolate
    values = spark.createDataFrame([("A", "d", 179.9, 0.0, 5.0), ("B", "d", -170.0, 0.0, 9.0)],
                                   "station string, date string, lon double, lat double, x double")
    cells = spark.createDataFrame([(0, 0, -179.9, 0.0, -179.9, 0.0, 0.1), (1, 0, -179.8, 0.0, -179.9, 0.0, 0.1)],
                                  "i long, j long, x double, y double, gx0 double, gy0 double, step double")
    blocks = interpolate._target_blocks(cells)
    sources = interpolate.source_blocks(values, ["date"], "station", ["x"], interpolate.TILE, interpolate.STATION_ROWS)
    served = interpolate._reach(sources, blocks, 50.0).collect()
    assert [r.lon0 for r in served] == [179.9]


def test_many_files_of_one_header_are_one_scan(spark, tmp_path):
    from stationweave.sources.readers import scan_measurements
    head = "AirQualityStationEoICode,AirPollutant,Concentration,AveragingTime,DatetimeBegin,DatetimeEnd"
    for i in range(40):
        (tmp_path / f"f{i}.csv").write_text(f"{head}\nS{i},NO2,{i}.5,hour,2024-01-01 00:00:00,2024-01-01 01:00:00\n")
    (tmp_path / "g.csv").write_text("Concentration,AirQualityStationEoICode\n7.5,S99\n")
    df = scan_measurements(spark, [str(p) for p in tmp_path.iterdir()])
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert sorted((r.station, r.concentration) for r in df.collect()) == sorted([(f"S{i}", i + 0.5) for i in range(40)] + [("S99", 7.5)])


def test_unknown_zones_warn_or_fail(spark):
    import pytest
    from stationweave.operators import selection
    zones = spark.createDataFrame([(2, "Z1", "One", "XX")], "level int, zone_id string, zone_name string, country_code string")
    with pytest.warns(UserWarning, match="Two"):
        found = selection.known_zones(selection.resolve_zone(zones, 2, ["One", "Two"]), ["One", "Two"])
    assert [r.zone_id for r in found.collect()] == ["Z1"]
    with pytest.raises(ValueError):
        selection.known_zones(selection.resolve_zone(zones, 2, ["Two"]), ["Two"])


def test_dense_index_follows_the_order_of_ids(spark):
    from stationweave.functions.sequences import dense_index
    ids = [f"{p}{i}" for p in ("A", "BB", "") for i in range(30)] + ["", "x" * 9]
    got = {r.k: r.n for r in dense_index(spark.createDataFrame([(i,) for i in ids], "k string").repartition(6), "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(ids))}
