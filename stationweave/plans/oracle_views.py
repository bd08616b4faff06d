"""The binding views restated as SQL for the comparison engine; shares no code with the Spark side."""

from __future__ import annotations

PARTS = ("click", "error", "purchase", "signup", "view")


def r(expression: str) -> str:
    """Rounded double without a negative zero; the shift decides exact halves in the seventh place."""
    return f"round(({expression}) + 2e-9, 6) + 0e0"


def stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


LOCAL = "((begin_ts at time zone 'UTC') at time zone 'CET')"


def _wide_column(p: str) -> str:
    return f"avg(case when pollutant = '{p}' then concentration end) as \"{p}\""


def _box(level: int, width: int, name: str) -> str:
    return (f"select {level} as level, substr(zone_id, 1, {width}) as zone_id, {name} as zone_name, min(x0) as x0, "
            f"max(x1) as x1, min(y0) as y0, max(y1) as y1 from zone group by substr(zone_id, 1, {width})")


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "kk": ((), "select greatest(7, cast(floor((max(user_id) + 1) / 20) as int)) as k from events"),
    "obs": ((), """select concat('S', lpad(cast(user_id as varchar), 6, '0')) as station, event_type as pollutant,
        value - 5e0 as concentration, 'hour' as averaging_time, date_trunc('hour', ts) as begin_ts,
        date_trunc('hour', ts) + interval 1 hour as end_ts from events"""),
    "wide": (("obs",), "select station, averaging_time, begin_ts, end_ts, "
             + ", ".join(_wide_column(p) for p in PARTS) + " from obs group by 1, 2, 3, 4"),
    "long": (("wide",), " union all ".join(
        f"select station, averaging_time, begin_ts, '{p}' as pollutant, \"{p}\" as x from wide" for p in PARTS)),
    "station": ((), """select concat('S', lpad(cast(c_custkey as varchar), 6, '0')) as station, c_name as station_name,
        5e0 + ((c_custkey * 37) % 1000) / 100e0 + 5e-3 as lon, 40e0 + ((c_custkey * 53) % 1000) / 100e0 + 5e-3 as lat,
        c_nationkey as nationkey from customer where c_custkey in (select user_id from events)"""),
    "sp": ((), """select concat('SP-S', lpad(cast(user_id as varchar), 6, '0'), '-', event_type) as sampling_point_id,
        concat('S', lpad(cast(user_id as varchar), 6, '0')) as station,
        case when c_nationkey % 7 <> 0 then concat('N', cast(c_nationkey as varchar)) end as nat_code,
        c_name as station_name,
        (['Italy', 'Germany', 'France', 'Greece', 'United Kingdom', 'Atlantis'])[c_nationkey % 6 + 1] as country,
        event_type as pollutant,
        case when event_type <> 'signup' then 5e0 + ((c_custkey * 37) % 1000) / 100e0 + 5e-3
            + case when event_type = 'error' then 1e-2 else 0e0 end end as longitude,
        case when event_type <> 'signup' then 40e0 + ((c_custkey * 53) % 1000) / 100e0 + 5e-3 end as latitude,
        c_acctbal as altitude, b as op_begin, case when event_type = 'click' then e end as op_end,
        'utc+01' as timezone, concat('XX', cast(c_nationkey % 5 as varchar)) as nuts1_id,
        concat('XX', cast(c_nationkey % 5 as varchar), cast(cast(floor(c_nationkey / 5) as int) as varchar)) as nuts2_id,
        lower(c_mktsegment) as type
        from (select user_id, event_type, min(ts) as b, max(ts) as e from events group by 1, 2) q
        join customer on c_custkey = user_id"""),
    "iso": (("sp",), """select *, case country when 'Italy' then 'IT' when 'Germany' then 'DE' when 'France' then 'FR'
        when 'Greece' then 'EL' when 'United Kingdom' then 'UK' end as iso from sp"""),
    "zone": ((), """select 2 as level, n_nationkey as nationkey, concat('XX', cast(n_nationkey % 5 as varchar),
        cast(cast(floor(n_nationkey / 5) as int) as varchar)) as zone_id, n_name as zone_name,
        5e0 + 2 * (n_nationkey % 5) as x0, 7e0 + 2 * (n_nationkey % 5) as x1,
        40e0 + 2 * cast(floor(n_nationkey / 5) as int) as y0, 42e0 + 2 * cast(floor(n_nationkey / 5) as int) as y1
        from nation"""),
    "zones": (("zone",), _box(0, 2, "'Everywhere'") + " union all "
              + _box(1, 3, "'Strip ' || substr(zone_id, 1, 3)")
              + " union all select level, zone_id, zone_name, x0, x1, y0, y1 from zone"),
    "district": (("station",), """select 4 as level, concat('L', station) as zone_id, station_name as zone_name,
        lon - 0.305e0 as x0, lon + 0.295e0 as x1, lat - 0.205e0 as y0, lat + 0.195e0 as y1 from station"""),
    "hours": ((), """select unnest(generate_series(date_trunc('day', min(ts)),
        date_trunc('day', max(ts)) + interval 23 hour, interval 1 hour)) as ts from events"""),
    "panel_obs": (("kk",), """select concat('P', lpad(cast(user_id % k as varchar), 4, '0')) as station,
        event_type as pollutant, date_trunc('hour', ts) as ts, avg(value) as x from events cross join kk group by 1, 2, 3"""),
    "panel": (("panel_obs", "hours"), """select h.station, p.pollutant, t.ts, o.x
        from (select distinct station from panel_obs) h cross join (select distinct pollutant from panel_obs) p
        cross join hours t
        left join panel_obs o on o.station = h.station and o.pollutant = p.pollutant and o.ts = t.ts"""),
    "pw": (("panel",), "select station, ts, " + ", ".join(
        f"max(case when pollutant = '{p}' then x end) as \"{p}\"" for p in PARTS) + " from panel group by 1, 2"),
    "ints": ((), "select unnest(generate_series(0, 400)) as n"),
}

KM = ("2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(lat - y) / 2), 2)"
      " + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))")


def sql(body: str, *views: str, extra: dict[str, str] | None = None, kept: bool = False) -> str:
    """Query text with the named views, and what they need, as common table expressions; ``kept`` stores the extra ones."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in VIEWS[name][0]:
            need(other)
        order.append(name)
    for v in views:
        need(v)
    parts = [f"{n} as ({VIEWS[n][1]})" for n in order] + [f"{n} as {'materialized ' if kept else ''}({t})" for n, t in (extra or {}).items()]
    return ("with " + ", ".join(parts) + " " if parts else "") + body
