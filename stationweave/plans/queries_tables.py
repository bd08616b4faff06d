"""Queries over scans, filters, joins and station attributes."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.functions import columns as C
from stationweave.functions import geometry
from stationweave.model import infer_pollutants, is_measurement_table, validate_contract
from stationweave.operators import aggregate, maps, selection, stations, summary, zones
from stationweave.plans.binding import POLLUTANTS, Tables
from stationweave.plans.oracle_views import PARTS, day, r, sql, stamp
from stationweave.plans.registry import query
from stationweave.sources import readers, writers

# Request parameters used by several queries.
BOX = ((6.5, 41.0), (12.25, 47.5))
HULL = [(6.0, 41.0), (13.0, 42.0), (12.0, 48.0), (9.0, 44.0), (7.0, 47.0)]
CONCAVE = [(6.0, 41.0), (14.0, 41.5), (9.5, 44.5), (13.5, 48.75), (6.5, 47.25)]


def polygon_sql(points: list, x: str = "lon", y: str = "lat") -> str:
    """Even-odd test written out edge by edge."""
    terms = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        terms.append(f"case when (({ay}e0 > {y}) <> ({by}e0 > {y})) and {x} < {ax}e0 + ({bx}e0 - {ax}e0) * ({y} - {ay}e0)"
                     f" / ({by}e0 - {ay}e0) then 1 else 0 end" if ay != by else "0")
    return "(" + " + ".join(terms) + ") % 2 = 1"


def hull_sql(points: list) -> str:
    return " and ".join(
        f"({bx}e0 - {ax}e0) * (lat - {ay}e0) - ({by}e0 - {ay}e0) * (lon - {ax}e0) >= 0"
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True))


WIDE_LIST = ", ".join(f'"{p}"' for p in PARTS)
WIDE_ROUNDED = ", ".join(f'{r(chr(34) + p + chr(34))} as "{p}"' for p in PARTS)
OBS_ROWS = (f"station, pollutant, {r('concentration')} as concentration, averaging_time, "
            f"{stamp('begin_ts')} as begin_ts, {stamp('end_ts')} as end_ts")
WIDE_ROWS = f"station, averaging_time, {stamp('begin_ts')} as begin_ts, {stamp('end_ts')} as end_ts, {WIDE_ROUNDED}"
SP_COLUMNS = ("sampling_point_id, station, nat_code, station_name, country, pollutant, "
              f"{r('longitude')} as longitude, {r('latitude')} as latitude")


# ---- sources and sinks

@query("scan_measurements", sql(
    "select station, pollutant, " + r("concentration") + " as concentration, "
    "case when pollutant <> 'error' then averaging_time end as averaging_time, "
    + stamp("begin_ts") + " as begin_ts, " + stamp("end_ts") + " as end_ts from obs", "obs"))
def _(t: Tables) -> DataFrame:
    header = {v: k for k, v in readers.EXTRACT_COLUMNS.items()}
    full, drifted = t.scratch("extract"), t.scratch("extract")
    rows = t.obs.withColumnsRenamed(header)
    rows.where("AirPollutant <> 'error'").write.option("header", True).csv(full)
    rows.where("AirPollutant = 'error'").drop("AveragingTime").write.option("header", True).csv(drifted)
    return readers.scan_measurements(t.spark, [full, drifted])


@query("scan_by_sampling_point", sql(
    "select " + OBS_ROWS + " from obs where concat('SP-', station, '-', pollutant) in "
    "(select sampling_point_id from sp where country = 'Italy') and year(begin_ts) = 2024", "obs", "sp"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("measurements") + ".parquet"
    own = t.obs.withColumn("sampling_point_id", F.concat_ws("-", F.lit("SP"), "station", "pollutant"))
    writers.write_measurements(own, path)
    wanted = t.sampling_point.where(F.col("country") == "Italy")
    kept = readers.scan_by_sampling_point(readers.scan_measurements(t.spark, path), wanted, 2024, 2024)
    return kept.select("station", "pollutant", "concentration", "averaging_time", "begin_ts", "end_ts")


@query("scan_stations", "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, "
       + r("c_acctbal") + " as c_acctbal, c_mktsegment from customer")
def _(t: Tables) -> DataFrame:
    return readers.scan_stations(t.spark, f"{t.folder}/customer.parquet")


@query("scan_vocabulary", "select p_partkey::bigint as code, p_name as notation, p_type as label, "
       "case when p_partkey % 3 <> 0 then concat('ug', p_size::varchar) end as recommended_unit from part")
def _(t: Tables) -> DataFrame:
    path = t.scratch("vocabulary")
    t.vocabulary_source.withColumnRenamed("Notation", "No tation").write.option("header", True).csv(path)
    return readers.scan_vocabulary(t.spark, path)


_BOX_COLUMNS = "x0, y0, x1, y1"


@query("scan_zones", sql("select level::bigint as level, zone_id, zone_name, x0, y0, x1, y1 from zones", "zones"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("zones") + ".parquet"
    (t.zones.withColumn("wkt", geometry.to_wkt(F.col("rings"))).drop("rings").write.parquet(path))
    return (zones.prepare_zones(readers.scan_zones(t.spark, path))
            .select("level", "zone_id", "zone_name", "box.*"))


@query("import_csv", sql(f"select {WIDE_ROWS} from wide", "wide"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("export") + ".csv"
    writers.export_csv(t.wide, path)
    return readers.import_csv(t.spark, path).df


@query("import_txt", sql(f"select {WIDE_ROWS} from wide", "wide"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("export") + ".txt"
    writers.export_txt(t.wide, path)
    return readers.import_txt(t.spark, path).df


@query("export_csv", sql(f"select {WIDE_ROWS} from wide", "wide"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("export") + ".csv"
    writers.export_csv(t.wide, path)
    raw = t.spark.read.option("header", True).csv(path)
    return raw.withColumns({p: F.col(p).cast("double") for p in POLLUTANTS})


@query("export_txt", sql(f"select {WIDE_ROWS} from wide", "wide"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("export") + ".txt"
    writers.export_txt(t.wide, path)
    raw = t.spark.read.option("header", True).option("sep", " ").option("nullValue", "NA").csv(path)
    return raw.withColumns({p: F.col(p).cast("double") for p in POLLUTANTS})


_WKT = ("concat('POLYGON ((', x0::varchar, ' ', y0::varchar, ', ', x1::varchar, ' ', y0::varchar, ', ', x1::varchar, ' ', "
        "y1::varchar, ', ', x0::varchar, ' ', y1::varchar, ', ', x0::varchar, ' ', y0::varchar, '))')")


@query("export_zone_geometry", sql(
    f"select level::bigint as level, zone_id, zone_name, {_WKT} as wkt from zone", "zone"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("zones")
    writers.export_zone_geometry(t.zone, path)
    return t.spark.read.parquet(path)


@query("import_zone_geometry", sql("select level::bigint as level, zone_id, zone_name, x0, y0, x1, y1 from zone", "zone"))
def _(t: Tables) -> DataFrame:
    path = t.scratch("zones")
    writers.export_zone_geometry(t.zone, path)
    back = readers.import_zone_geometry(t.spark, path)
    return zones.prepare_zones(back).select("level", "zone_id", "zone_name", "box.*")


@query("infer_pollutants", sql("select pollutant, count(x)::bigint as n from long group by 1", "long"))
def _(t: Tables) -> DataFrame:
    found = infer_pollutants(t.wide)
    return aggregate.pivot_longer(t.wide, found).groupBy("pollutant").agg(F.count("concentration").alias("n"))


@query("validate_contract", sql(
    "select 'long' as kind, true as valid, count(*)::bigint as n from obs union all "
    "select 'wide', true, count(*)::bigint from wide union all "
    "select 'neither', false, count(*)::bigint from station", "obs", "wide", "station"))
def _(t: Tables) -> DataFrame:
    def row(df: DataFrame) -> DataFrame:
        good = is_measurement_table(df)
        kind = validate_contract(df) if good else "neither"
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), F.lit(good).alias("valid"), "n")
    return row(t.obs).unionByName(row(t.wide)).unionByName(row(t.station))


# ---- filters and projections

_FIRST_SP = ("select *, row_number() over (partition by station order by sampling_point_id) as rn from iso")


@query("stations_by_station", sql(
    f"select country, iso, station, nat_code, station_name, {r('longitude')} as longitude, {r('latitude')} as latitude, "
    f"{r('altitude')} as altitude, nuts1_id, nuts2_id, type, 'UTC+01' as timezone, "
    f"case when op_end is null then 'active' else 'closed' end as sampling_point_status from ({_FIRST_SP}) q where rn = 1",
    "iso", extra={}))
def _(t: Tables) -> DataFrame:
    ready = t.sampling_point.withColumns({
        "iso": C.country_to_iso("country"), "sampling_point_status": C.sampling_point_status("op_end"),
        "timezone": F.upper("timezone")})
    return stations.stations_by_station(ready)


@query("stations_compact", sql(
    f"select country, iso, sampling_point_id, station, nat_code, station_name, pollutant, "
    f"case when op_end is null then 'active' else 'closed' end as sampling_point_status, {r('longitude')} as longitude, "
    f"{r('latitude')} as latitude, {r('altitude')} as altitude, type from iso", "iso"))
def _(t: Tables) -> DataFrame:
    ready = t.sampling_point.withColumns({
        "iso": C.country_to_iso("country"), "sampling_point_status": C.sampling_point_status("op_end")})
    return stations.stations_compact(ready)


@query("filter_dates", sql(
    f"select {OBS_ROWS} from obs where begin_ts >= timestamp '2024-01-05' and end_ts <= timestamp '2024-01-12'", "obs"))
def _(t: Tables) -> DataFrame:
    return selection.filter_dates(t.obs, "2024-01-05", "2024-01-12")


@query("filter_years", sql(
    f"select {OBS_ROWS} from (select * replace (case when pollutant = 'click' then begin_ts - interval 24 month "
    "else begin_ts end as begin_ts) from obs) q where year(begin_ts) between 2023 and 2024", "obs"))
def _(t: Tables) -> DataFrame:
    """One pollutant is moved two years back and so falls out of the range."""
    earlier = F.when(F.col("pollutant") == "click", F.col("begin_ts") - F.expr("interval 24 months"))
    return readers.filter_years(t.obs.withColumn("begin_ts", F.coalesce(earlier, "begin_ts")), 2023, 2024)


@query("filter_pollutant", sql(
    f"select {OBS_ROWS} from obs where pollutant in ('click') or ascii(pollutant) in (118)", "obs"))
def _(t: Tables) -> DataFrame:
    kept = selection.filter_pollutant(t.obs, ["click", 118], t.vocabulary)
    return kept.select(*t.obs.columns)


@query("check_availability", sql(
    "select w as pollutant, w in (select pollutant from obs) as available from "
    "(select unnest(['click', 'ozone', 'view', 'radon']) as w) q", "obs"))
def _(t: Tables) -> DataFrame:
    wanted = ["click", "ozone", "view", "radon"]
    absent = selection.missing_values(t.obs, "pollutant", wanted).withColumn("available", F.lit(False))
    present = (t.obs.select("pollutant").distinct().where(F.col("pollutant").isin(wanted))
               .withColumn("available", F.lit(True)))
    return absent.unionByName(present)


@query("resolve_zone", sql(
    "select asked, coalesce(a, i) as zone_id from (select w as asked, "
    "(select min(zone_id) from zones where level = 0 and (zone_name = w or zone_id = w)) as a, "
    "(select min(iso) from iso where country = w and iso is not null) as i "
    "from (select unnest(['Everywhere', 'Italy', 'XX', 'Atlantis', 'Nowhere']) as w) q) p where coalesce(a, i) is not null",
    "zones", "iso"))
def _(t: Tables) -> DataFrame:
    ready = t.sampling_point.withColumn("iso", C.country_to_iso("country"))
    return selection.resolve_zone(t.zones, 0, ["Everywhere", "Italy", "XX", "Atlantis", "Nowhere"], ready)


@query("select_by_zone", sql(
    "select station, pollutant, nuts2_id from sp where nuts2_id in "
    "(select zone_id from zone where zone_name in ('NATION_3', 'NATION_12') or zone_id = 'XX20')", "sp", "zone"))
def _(t: Tables) -> DataFrame:
    ids = selection.resolve_zone(t.zones, 2, ["NATION_3", "NATION_12", "XX20"])
    return selection.select_by_zone(t.sampling_point, "nuts2_id", ids).select("station", "pollutant", "nuts2_id")


@query("zone_children", sql(
    "select zone_id, zone_name from zones where level = 2 and substr(zone_id, 1, 3) in ('XX1', 'XX4')", "zones"))
def _(t: Tables) -> DataFrame:
    parents = t.zones.where(F.col("zone_id").isin("XX1", "XX4"))
    return zones.zone_children(t.zones, parents, 1, 2).select("zone_id", "zone_name")


@query("zone_level_code", sql(
    "select zone_id, case when level < 4 then level else 4 end::bigint as code from "
    "(select zone_id, level from zones union all select zone_id, level from district) q", "zones", "district"))
def _(t: Tables) -> DataFrame:
    both = t.zones.select("zone_id", "level").unionByName(t.district.select("zone_id", "level"))
    name = F.when(F.col("level") < 4, F.concat(F.lit("NUTS"), F.col("level").cast("string"))).otherwise("LAU")
    return both.select("zone_id", C.zone_level_code(name).alias("code"))


@query("exclude_stations", sql(
    f"select {OBS_ROWS} from obs where station not in (select station from station where nationkey % 3 = 0)",
    "obs", "station"))
def _(t: Tables) -> DataFrame:
    return selection.not_in_filter(t.obs, t.station.where(F.col("nationkey") % 3 == 0), "station")


@query("drop_all_null_groups", sql(
    f"select station, pollutant, {stamp('begin_ts')} as begin_ts, {r('x')} as concentration from (select station, pollutant, "
    "begin_ts, case when pollutant <> 'error' or station like '%0' then x end as x from long) l semi join "
    "(select station, pollutant from long where pollutant <> 'error' or station like '%0' group by all having count(x) > 0) m "
    "using (station, pollutant)", "long"))
def _(t: Tables) -> DataFrame:
    """Nine of ten stations lose all readings of one pollutant."""
    long = aggregate.pivot_longer(t.wide, POLLUTANTS).withColumn("concentration", F.when(
        (F.col("pollutant") != "error") | F.col("station").endswith("0"), F.col("concentration")))
    return selection.drop_all_null_groups(long, ["station", "pollutant"], "concentration").select(
        "station", "pollutant", "begin_ts", "concentration")


@query("sanitize_nonpositive", sql(
    f"select station, {stamp('begin_ts')} as begin_ts, "
    + ", ".join(f'case when "{p}" > 0 then {r(chr(34) + p + chr(34))} end as "{p}"' for p in PARTS) + " from wide", "wide"))
def _(t: Tables) -> DataFrame:
    return selection.sanitize_nonpositive(t.wide, POLLUTANTS).select("station", "begin_ts", *POLLUTANTS)


@query("clip_floor", sql(
    f"select station, pollutant, {stamp('begin_ts')} as begin_ts, "
    f"case when x <= 0 then 0.01e0 else {r('x')} end as x from long", "long"))
def _(t: Tables) -> DataFrame:
    long = aggregate.pivot_longer(t.wide, POLLUTANTS)
    return long.select("station", "pollutant", "begin_ts", C.clip_floor("concentration").alias("x"))


@query("nan_inf_to_null", sql(
    f"select station, pollutant, {stamp('begin_ts')} as begin_ts, "
    f"case when concentration > 0 and abs(concentration) <> 5e0 then {r('concentration')} end as x from obs", "obs"))
def _(t: Tables) -> DataFrame:
    c = F.col("concentration")
    spoiled = (F.when(c == 0, float("nan")).when(c < 0, float("-inf")).when(c == 5, float("inf")).otherwise(c))
    return t.obs.select("station", "pollutant", "begin_ts", C.nan_inf_to_null(spoiled).alias("x"))


@query("drop_incomplete_rows", sql(
    f"select sampling_point_id, {r('longitude')} as longitude, nat_code from sp "
    "where longitude is not null and nat_code is not null", "sp"))
def _(t: Tables) -> DataFrame:
    return selection.drop_incomplete_rows(t.sampling_point.select("sampling_point_id", "longitude", "nat_code"))


@query("filter_hourly", sql(
    f"select {OBS_ROWS} from (select * replace (case when pollutant in ('click', 'view') then 'day' else averaging_time end "
    "as averaging_time) from obs) q where averaging_time = 'hour'", "obs"))
def _(t: Tables) -> DataFrame:
    """Two pollutants are daily ones and go."""
    kind = F.when(F.col("pollutant").isin("click", "view"), "day").otherwise(F.col("averaging_time"))
    return selection.filter_hourly(t.obs.withColumn("averaging_time", kind))


@query("normalize_columns", "select n_nationkey::bigint as nationkey, n_name as nationname from nation")
def _(t: Tables) -> DataFrame:
    return readers.normalize_columns(t.read("nation").select(
        F.col("n_nationkey").alias("nation key"), F.col("n_name").alias("nation name")))


@query("country_to_iso", sql("select sampling_point_id, country, iso from iso", "iso"))
def _(t: Tables) -> DataFrame:
    return t.sampling_point.select("sampling_point_id", "country", C.country_to_iso("country").alias("iso"))


@query("sampling_point_status", sql(
    "select sampling_point_id, case when op_end is null then 'active' else 'closed' end as status from sp", "sp"))
def _(t: Tables) -> DataFrame:
    return t.sampling_point.select("sampling_point_id", C.sampling_point_status("op_end").alias("status"))


@query("clean_names", "select c_custkey, 'Main ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Site' as name, "
       "'UTC+01' as timezone from customer")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('"MAIN '), F.col("c_mktsegment"), F.lit('\n site"'))
    return t.read("customer").select(
        "c_custkey", C.clean_station_name(raw).alias("name"), F.upper(F.lit("utc+01")).alias("timezone"))


@query("vocab_code", "select p_partkey, p_partkey::bigint as code from part")
def _(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", C.vocabulary_code(
        F.concat(F.lit("http://vocabulary.test/pollutant/"), F.col("p_partkey").cast("string"))).alias("code"))


@query("vocab_unit", "select p_partkey, case when p_partkey % 3 <> 0 then concat('ug', p_size::varchar) end as unit from part")
def _(t: Tables) -> DataFrame:
    return readers.parse_vocabulary(t.vocabulary_source).select(
        F.col("code").cast("bigint").alias("p_partkey"), F.col("recommended_unit").alias("unit"))


@query("reorder_columns", sql(
    f"select station, {stamp('begin_ts')} as begin_ts, {WIDE_ROUNDED}, averaging_time from wide", "wide"))
def _(t: Tables) -> DataFrame:
    return stations.reorder_columns(t.wide.drop("end_ts"), ["station", "begin_ts"], ["averaging_time"])


# ---- joins

@query("attach_station_name", sql(
    f"select o.station, s.station_name, o.pollutant, {r('concentration')} as concentration, "
    f"{stamp('begin_ts')} as begin_ts from obs o left join station s on s.station = o.station", "obs", "station"))
def _(t: Tables) -> DataFrame:
    return stations.attach_station_name(
        t.obs.select("station", "pollutant", "concentration", "begin_ts"), t.sampling_point)


@query("attach_coordinates", sql(
    f"select o.station, o.pollutant, {stamp('begin_ts')} as begin_ts, {r('lon')} as lon, {r('lat')} as lat "
    "from obs o left join station s on s.station = o.station", "obs", "station"))
def _(t: Tables) -> DataFrame:
    return stations.attach_coordinates(t.obs.select("station", "pollutant", "begin_ts"), t.station)


@query("stations_info", sql(
    f"select {SP_COLUMNS} from sp where pollutant in ('click', 'view') and station in (select station from obs)",
    "sp", "obs"))
def _(t: Tables) -> DataFrame:
    return stations.stations_info(t.obs, t.sampling_point, ["click", "view"]).select(
        "sampling_point_id", "station", "nat_code", "station_name", "country", "pollutant", "longitude", "latitude")


_MODAL = """modal as (select station, nat_code, station_name, longitude, latitude from (
    select *, row_number() over (partition by station, nat_code, station_name order by n desc, longitude, latitude) as rn
    from (select station, nat_code, station_name, longitude, latitude, count(*) as n from sp
          where longitude is not null group by 1, 2, 3, 4, 5) a) b where rn = 1)"""


@query("modal_coordinate", sql("select * from (with " + _MODAL + " select station, nat_code, station_name, "
                               f"{r('longitude')} as longitude, {r('latitude')} as latitude from modal) z", "sp"))
def _(t: Tables) -> DataFrame:
    return stations.modal_coordinate(t.sampling_point)


@query("attach_modal_coordinates", sql(
    "select * from (with " + _MODAL + f" select sampling_point_id, {r('m.longitude')} as longitude, "
    f"{r('m.latitude')} as latitude from sp left join modal m on m.station = sp.station and m.station_name = sp.station_name "
    "and m.nat_code is not distinct from sp.nat_code) z", "sp"))
def _(t: Tables) -> DataFrame:
    sp = t.sampling_point
    return stations.attach_modal_coordinates(sp, stations.modal_coordinate(sp)).select(
        "sampling_point_id", "longitude", "latitude")


@query("attach_zone_attributes", sql(
    "select sampling_point_id, zone_id from sp left join station s on s.station = sp.station left join zone z "
    "on s.lon >= x0 and s.lon < x1 and s.lat >= y0 and s.lat < y1", "sp", "station", "zone"))
def _(t: Tables) -> DataFrame:
    sp = t.sampling_point
    places = stations.modal_coordinate(sp).withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")})
    # Stations whose only sampling point has no coordinate take their place from the station list.
    own = t.station.select("station", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    keys = sp.select(*stations.STATION_KEY).distinct()
    located = stations.attach_zone_attributes(keys, places).join(own, "station").select(
        *stations.STATION_KEY, F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    zoned = zones.point_in_zone(located, t.zone, ["station"]).select(*stations.STATION_KEY, "zone_id")
    return stations.attach_zone_attributes(sp, zoned).select("sampling_point_id", "zone_id")


@query("point_in_zone", sql(
    "select station, zone_id from station left join zone on lon >= x0 and lon < x1 and lat >= y0 and lat < y1",
    "station", "zone"))
def _(t: Tables) -> DataFrame:
    return zones.point_in_zone(t.station, t.zone, ["station"]).select("station", "zone_id")


@query("select_in_box", sql(
    "select station, station_name from station where lon between 6.5 and 12.25 and lat between 41e0 and 47.5", "station"))
def _(t: Tables) -> DataFrame:
    return selection.select_in_box(t.station, *BOX).select("station", "station_name")


@query("select_in_hull", sql(
    f"select station from station where {hull_sql([(6.0, 41.0), (13.0, 42.0), (12.0, 48.0), (7.0, 47.0)])}", "station"))
def _(t: Tables) -> DataFrame:
    return zones.select_in_hull(t.station, HULL).select("station")


@query("select_in_polygon", sql(f"select station from station where {polygon_sql(CONCAVE)}", "station"))
def _(t: Tables) -> DataFrame:
    return zones.select_in_polygon(t.station, CONCAVE).select("station")


_TRIANGLE = [(6.25, 41.25), (12.75, 42.5), (8.5, 47.75)]


def _triangle_meets() -> str:
    """Triangle against rectangle: separating axes of two convex shapes."""
    parts = ["x0 <= 12.75e0", "x1 >= 6.25e0", "y0 <= 47.75e0", "y1 >= 41.25e0"]
    for (ax, ay), (bx, by) in zip(_TRIANGLE, _TRIANGLE[1:] + _TRIANGLE[:1], strict=True):
        side = [f"({bx}e0 - {ax}e0) * ({y} - {ay}e0) - ({by}e0 - {ay}e0) * ({x} - {ax}e0)"
                for x in ("x0", "x1") for y in ("y0", "y1")]
        parts.append("greatest(" + ", ".join(side) + ") >= 0")
    return " and ".join(parts)


@query("zones_intersecting", sql(
    f"select zone_id from zone where {_triangle_meets()} union all "
    f"select zone_id from district where {_triangle_meets()}", "zone", "district"))
def _(t: Tables) -> DataFrame:
    both = t.zone.unionByName(t.district)
    return zones.zones_intersecting(both, _TRIANGLE).select("zone_id")


_OVERLAP = ("select d.zone_id, z.zone_id as parent_id, radians(least(d.x1, z.x1) - greatest(d.x0, z.x0)) * "
            "(sin(radians(least(d.y1, z.y1))) - sin(radians(greatest(d.y0, z.y0)))) * 6371.0088e0 * 6371.0088e0 as area_km2 "
            "from district d join zone z on d.x0 < z.x1 and z.x0 < d.x1 and d.y0 < z.y1 and z.y0 < d.y1")


@query("zone_largest_overlap", sql(
    f"select zone_id, parent_id, {r('area_km2')} as area_km2 from (select *, row_number() over (partition by zone_id "
    f"order by round(area_km2, 6) desc, parent_id) as rn from ({_OVERLAP}) a) b where rn = 1", "district", "zone"))
def _(t: Tables) -> DataFrame:
    return zones.zone_largest_overlap(t.district, t.zone)


@query("country_name_lookup", sql("select zone_id, 'Everywhere' as country_name from zones", "zones"))
def _(t: Tables) -> DataFrame:
    return zones.country_name_lookup(t.zones).select("zone_id", "country_name")


@query("merge_pollutants", sql(
    f"select a.station, {stamp('a.begin_ts')} as begin_ts, {r('a.click')} as click, {r('b.view')} as \"view\" "
    "from wide a left join wide b on b.station = a.station and b.begin_ts = a.begin_ts and b.view is not null", "wide"))
def _(t: Tables) -> DataFrame:
    w = t.wide
    return stations.merge_pollutants(w.select("station", "begin_ts", "click"),
                                     w.where(F.col("view").isNotNull()).select("station", "begin_ts", "view"))


@query("attach_covariates", sql(
    f"select p.station, pollutant, {stamp('ts')} as ts, {r('5e0 + ((n * 37) % 100) / 100e0')} as lon, "
    f"{r('40e0 + ((n * 53) % 100) / 100e0')} as lat, case when n % 2 = 0 then 'traffic' else 'background' end as type "
    "from (select *, cast(substr(station, 2, 4) as int) as n from panel_obs) p", "panel_obs"))
def _(t: Tables) -> DataFrame:
    return stations.attach_covariates(t.panel_obs, t.panel_place, ["lon", "lat", "type"]).drop("x")


@query("attach_zone_values", sql(
    f"select z.zone_id, {r('v.value')} as value from zone z left join (select zone_id, avg(concentration) as value "
    "from obs o join station s on s.station = o.station join zone on lon >= x0 and lon < x1 and lat >= y0 and lat < y1 "
    "where pollutant = 'view' group by 1) v on v.zone_id = z.zone_id", "zone", "obs", "station"))
def _(t: Tables) -> DataFrame:
    placed = zones.point_in_zone(t.station, t.zone, ["station"]).select("station", "zone_id")
    values = zones.zonal_mean(t.obs.where("pollutant = 'view'").join(placed, "station"), [], "concentration")
    return zones.attach_zone_values(t.zone, values.withColumnRenamed("concentration", "value")).select("zone_id", "value")


@query("semi_in_unique", sql(
    "select station, station_name from station where station in (select station from obs where pollutant = 'signup')",
    "station", "obs"))
def _(t: Tables) -> DataFrame:
    return selection.in_filter(t.station, t.obs.where("pollutant = 'signup'"), "station").select("station", "station_name")


@query("in_filter", sql(
    f"select {OBS_ROWS} from obs where station in (select station from station where nationkey in (1, 2, 3))",
    "obs", "station"))
def _(t: Tables) -> DataFrame:
    return selection.in_filter(t.obs, t.station.where("nationkey in (1, 2, 3)"), "station")


@query("not_in_filter", sql(
    "select sampling_point_id, nat_code from sp where nat_code is null or nat_code not in ('N1', 'N2', 'N3')", "sp"))
def _(t: Tables) -> DataFrame:
    sp = t.sampling_point
    return selection.not_in_filter(sp, sp.where("nat_code in ('N1', 'N2', 'N3')"), "nat_code").select(
        "sampling_point_id", "nat_code")


# ---- rows, sets, reshaping

@query("first_row", sql(
    f"select {SP_COLUMNS} from (select *, row_number() over (partition by station order by sampling_point_id) as rn "
    "from sp) q where rn = 1", "sp"))
def _(t: Tables) -> DataFrame:
    return stations.first_row(t.sampling_point, ["station"], ["sampling_point_id"]).select(
        "sampling_point_id", "station", "nat_code", "station_name", "country", "pollutant", "longitude", "latitude")


@query("slice_max", sql(
    f"select station, pollutant, {stamp('begin_ts')} as begin_ts, {r('concentration')} as concentration from (select *, "
    "row_number() over (partition by station order by concentration desc, begin_ts, pollutant) as rn from obs) q "
    "where rn = 1", "obs"))
def _(t: Tables) -> DataFrame:
    rows = t.obs.select("station", "pollutant", "begin_ts", "concentration")
    return stations.slice_max(rows, ["station"], "concentration", ["begin_ts", "pollutant"])


@query("union_by_name", sql(
    "select station as code, station_name as name, null::varchar as country from station union all "
    "select distinct station, null::varchar, country from sp", "station", "sp"))
def _(t: Tables) -> DataFrame:
    return readers.union_by_name([
        t.station.select(F.col("station").alias("code"), F.col("station_name").alias("name")),
        t.sampling_point.select("country", F.col("station").alias("code")).distinct()])


@query("distinct_rows", sql("select distinct station, pollutant from obs", "obs"))
def _(t: Tables) -> DataFrame:
    return t.obs.select("station", "pollutant").distinct()


@query("pivot_wider", sql(
    "select station, " + ", ".join(f"string_agg(distinct case when pollutant = '{p}' then averaging_time end, ', ') as \"{p}\""
                                   for p in PARTS) + " from obs group by 1", "obs"))
def _(t: Tables) -> DataFrame:
    kinds = t.obs.select("station", "pollutant", "averaging_time").distinct()
    lists = aggregate.pivot_wider(kinds, ["station"], "pollutant", POLLUTANTS, F.collect_list("averaging_time"))
    return lists.select("station", *[
        F.when(F.size(p) > 0, F.array_join(F.array_sort(p), ", ")).alias(p) for p in POLLUTANTS])


@query("pivot_longer", sql(
    f"select station, {stamp('begin_ts')} as begin_ts, pollutant, {r('x')} as concentration from long", "long"))
def _(t: Tables) -> DataFrame:
    return aggregate.pivot_longer(t.wide.select("station", "begin_ts", *POLLUTANTS), POLLUTANTS)


@query("cross_grid", sql(
    "select a.pollutant as pollutant_1, b.pollutant as pollutant_2, s.station from (select distinct pollutant from obs) a "
    "cross join (select distinct pollutant from obs) b cross join (select distinct station from obs) s", "obs"))
def _(t: Tables) -> DataFrame:
    names = t.obs.select("pollutant").distinct().agg(F.collect_list("pollutant")).scalar()
    return (t.obs.select("station").distinct().withColumn("pollutant_1", F.explode(names))
            .withColumn("pollutant_2", F.explode(names)))


@query("bind_cols", sql(
    f"select station, count(x)::bigint as n, {r('avg(x)')} as mean, {r('max(x)')} as max from long group by 1", "long"))
def _(t: Tables) -> DataFrame:
    long = aggregate.pivot_longer(t.wide, POLLUTANTS)
    return long.groupBy("station").agg(F.count("concentration").alias("n"), F.avg("concentration").alias("mean"),
                                       F.max("concentration").alias("max"))


@query("sort_station_time", sql(f"select {WIDE_ROWS} from wide", "wide"))
def _(t: Tables) -> DataFrame:
    return aggregate.sort_station_time(t.wide)


@query("first_n_hours", sql(
    f"select {OBS_ROWS} from obs where begin_ts < (select min(begin_ts) from obs) + interval 6 hour", "obs"))
def _(t: Tables) -> DataFrame:
    return selection.first_hours(t.obs, 6, "begin_ts")


@query("calendar_fields", sql(
    f"select station, pollutant, {stamp('begin_ts')} as begin_ts, year(begin_ts)::bigint as year, "
    "month(begin_ts)::bigint as month, day(begin_ts)::bigint as day, hour(begin_ts)::bigint + 1 as hour_slot, "
    "dayofweek(begin_ts)::bigint + 1 as weekday, (floor((dayofyear(begin_ts) - 1) / 7) + 1)::bigint as week, "
    "(dayofweek(begin_ts) * 24 + hour(begin_ts) + 1)::bigint as time_of_week, "
    f"{day('begin_ts')} as day_text, {r('(epoch(end_ts) - epoch(begin_ts)) / 3600e0')} as hours from obs", "obs"))
def _(t: Tables) -> DataFrame:
    ts = F.col("begin_ts")
    return t.obs.select(
        "station", "pollutant", "begin_ts", F.year(ts).alias("year"), F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"), C.hour_slot(ts).alias("hour_slot"), C.weekday(ts).alias("weekday"),
        C.week_of_year(ts).alias("week"), C.time_of_week(ts).alias("time_of_week"), F.to_date(ts).alias("day_text"),
        C.hours_between(ts, F.col("end_ts")).alias("hours"))


# ---- map data

@query("station_pollutant_label", sql(
    "select station, concat_ws(', ', max(case when pollutant = 'view' then 'view' end), "
    "max(case when pollutant = 'click' then 'click' end), max(case when pollutant = 'error' then 'error' end)) as pollutants "
    "from sp where pollutant in ('view', 'click', 'error') group by 1", "sp"))
def _(t: Tables) -> DataFrame:
    return maps.station_pollutant_label(t.sampling_point, ["view", "click", "error"])


@query("station_points", sql(
    f"select country, iso, station, nat_code, station_name, {r('longitude')} as longitude, {r('latitude')} as latitude, "
    "concat_ws(', ', max(case when pollutant = 'view' then 'view' end), max(case when pollutant = 'error' then 'error' end)) "
    "as pollutants from iso where pollutant in ('view', 'error') and nuts1_id in ('XX1', 'XX2') and iso is not null "
    "and nat_code is not null and longitude is not null and station in (select station from obs) "
    "group by country, iso, station, nat_code, station_name, longitude, latitude", "iso", "obs"))
def _(t: Tables) -> DataFrame:
    ready = t.sampling_point.withColumn("iso", C.country_to_iso("country"))
    return maps.station_points(ready, ["view", "error"], "nuts1_id", ["XX1", "XX2"], t.obs)


@query("zone_bounds", sql(
    "select 'outer' as role, zone_id from zones where zone_id = 'XX1' union all "
    "select 'inner', zone_id from zones where level = 2 and zone_id like 'XX1_' union all "
    "select 'inner-local', zone_id from (select *, row_number() over (partition by zone_id order by round(area_km2, 6) desc, "
    f"parent_id) as rn from (select d.zone_id, z.zone_id as parent_id, {_OVERLAP.split('as parent_id, ')[1].replace('join zone z', 'join zones z')} "
    "and z.level = 1) a) b where rn = 1 and parent_id = 'XX1'", "zones", "district"))
def _(t: Tables) -> DataFrame:
    local = maps.zone_bounds(t.zones, "NUTS1", ["XX1"], "LAU", local_zones=t.district).where("role = 'inner'")
    near = maps.zone_bounds(t.zones, "NUTS1", ["XX1"], "NUTS2")
    return near.select("role", "zone_id").unionByName(local.select(F.lit("inner-local").alias("role"), "zone_id"))


_LEVELS = {1: "nuts1", 2: "nuts2", 4: "lau"}
_MASTER_ZONES = "select level, zone_id, zone_name, x0, x1, y0, y1 from zones where level in (1, 2) union all " \
                "select level, zone_id, zone_name, x0, x1, y0, y1 from district"


@query("master_zones", sql(
    "select sampling_point_id, " + ", ".join(
        f"(select min(zone_id) from mz where level = {level} and longitude >= x0 and longitude < x1 and latitude >= y0 and "
        f"latitude < y1) as {name}_id, (select min(zone_name) from mz where level = {level} and zone_id = (select min(zone_id) "
        f"from mz where level = {level} and longitude >= x0 and longitude < x1 and latitude >= y0 and latitude < y1)) as {name}"
        for level, name in _LEVELS.items()) + " from sp", "sp", "zones", "district", extra={"mz": _MASTER_ZONES}))
def _(t: Tables) -> DataFrame:
    columns = ["level", "zone_id", "zone_name", "rings"]
    table = t.zones.where("level in (1, 2)").select(*columns).unionByName(t.district.select(*columns))
    return zones.assign_zones(t.sampling_point, table).select(
        "sampling_point_id", *[c for n in _LEVELS.values() for c in (f"{n}_id", n)])


@query("request_by_code", sql(
    f"select station, pollutant, {stamp('begin_ts')} as begin_ts, {r('x')} as x from long where pollutant in "
    "(select event_type from events where ascii(event_type) = ascii('view') or event_type = 'click')", "long"))
def _(t: Tables) -> DataFrame:
    wanted = selection.notations(["click", ord("v")], t.vocabulary)
    return aggregate.pivot_longer(t.wide, POLLUTANTS).where(F.col("pollutant").isin(wanted)).select(
        "station", "pollutant", "begin_ts", F.col("concentration").alias("x"))


@query("summary_stations", sql(
    f"select {SP_COLUMNS} from sp where station in (select station from wide) and pollutant in ('click', 'error')", "sp", "wide"))
def _(t: Tables) -> DataFrame:
    tables = summary.summary(t.wide, ["click", "error"], t.sampling_point)
    return tables["stations"].select(
        "sampling_point_id", "station", "nat_code", "station_name", "country", "pollutant", "longitude", "latitude")
