"""Scalar Column expressions shared by the operators."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

# Fixed values.
EARTH_RADIUS_KM = 6371.0088
CLIP_FLOOR = 0.01
LOCAL_ZONE = "CET"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_inf_to_null(value: Column | str) -> Column:
    """NULL for NaN and both infinities."""
    c = _col(value)
    bad = F.isnan(c) | (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))
    return F.when(~bad, c)


def positive_or_null(value: Column | str) -> Column:
    """NULL for zero and negative readings."""
    c = _col(value)
    return F.when(c > 0, c)


def clip_floor(value: Column | str, floor: float = CLIP_FLOOR) -> Column:
    """Replace non-positive estimates by the floor; NULL stays NULL."""
    c = _col(value)
    return F.when(c <= 0, F.lit(floor)).otherwise(c)


def local_time(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """UTC instant shown on the local clock, daylight saving included."""
    return F.from_utc_timestamp(_col(ts).cast("timestamp"), zone)


def period_start(local: Column, frequency: str) -> Column:
    """Label of the calendar period; weeks start on Monday, hourly labels are timestamps."""
    if frequency == "yearly":
        return F.trunc(local, "year")
    if frequency == "monthly":
        return F.trunc(local, "month")
    if frequency == "weekly":
        return F.to_date(F.date_trunc("week", local))
    if frequency == "daily":
        return F.to_date(local)
    if frequency == "hourly":
        return F.date_trunc("hour", local)
    raise ValueError(f"unknown frequency: {frequency}")


def week_of_year(ts: Column | str) -> Column:
    """Week counted from 1 January in steps of seven days (not the ISO week)."""
    return (F.floor((F.dayofyear(_col(ts)) - 1) / 7) + 1).cast("int")


def weekday(ts: Column | str) -> Column:
    """1 = Sunday .. 7 = Saturday."""
    return F.dayofweek(_col(ts))


def hour_slot(ts: Column | str) -> Column:
    """1 .. 24."""
    return F.hour(_col(ts)) + 1


def time_of_week(ts: Column | str) -> Column:
    """1 .. 168, starting Sunday 00:00."""
    return (weekday(ts) - 1) * 24 + hour_slot(ts)


def hour_index(ts: Column | str) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_timestamp(_col(ts).cast("timestamp")) / 3600).cast("long")


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(3600.0)


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat = F.sin(F.radians(lat2 - lat1) / 2)
    dlon = F.sin(F.radians(lon2 - lon1) / 2)
    h = dlat * dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * dlon * dlon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def value_class(value: Column | str, low: Column, high: Column, classes: int = 6) -> Column:
    """Equal-width class 1..classes over [low, high]; the maximum falls in the last class."""
    c = _col(value)
    return F.least(F.width_bucket(c, low, high, F.lit(classes)), F.lit(classes)).cast("long")


def zone_level_code(level: Column | str) -> Column:
    """NUTS0..NUTS3 -> 0..3, anything else (LAU) -> 4."""
    c = _col(level)
    return F.when(F.length(c) == 5, F.substring(c, 5, 1).try_cast("int")).otherwise(F.lit(4)).cast("long")


def level_number(level: str) -> int:
    """Driver-side twin of zone_level_code for request parameters."""
    if level == "LAU":
        return 4
    if len(level) == 5 and level.startswith("NUTS") and level[4] in "0123":
        return int(level[4])
    raise ValueError(f"unknown zone level: {level}")


def vocabulary_code(uri: Column | str) -> Column:
    """Integer after the last slash of a vocabulary address."""
    return F.regexp_extract(_col(uri), "/([0-9]+)$", 1).try_cast("int")


def vocabulary_unit(definition: Column | str) -> Column:
    """Text after the unit marker of a vocabulary definition."""
    return F.try_element_at(F.split(_col(definition), "- recommended unit: "), F.lit(2))


# Country name -> code.
COUNTRY_CODES = {
    "Albania": "AL", "Andorra": "AD", "Austria": "AT", "Belgium": "BE", "Bosnia and Herzegovina": "BA",
    "Bulgaria": "BG", "Croatia": "HR", "Cyprus": "CY", "Czechia": "CZ", "Denmark": "DK", "Estonia": "EE",
    "Finland": "FI", "France": "FR", "Georgia": "GE", "Germany": "DE", "Greece": "EL", "Hungary": "HU",
    "Iceland": "IS", "Ireland": "IE", "Italy": "IT", "Kosovo under UNSCR 1244/99": "XK", "Latvia": "LV",
    "Lithuania": "LT", "Luxembourg": "LU", "Malta": "MT", "Montenegro": "ME", "Netherlands": "NL",
    "North Macedonia": "MK", "Norway": "NO", "Poland": "PL", "Portugal": "PT", "Romania": "RO",
    "Serbia": "RS", "Slovakia": "SK", "Slovenia": "SI", "Spain": "ES", "Sweden": "SE", "Switzerland": "CH",
    "Türkiye": "TR", "Ukraine": "UA", "United Kingdom": "UK",
}


def country_to_iso(country: Column | str) -> Column:
    """Country name to its two-letter code; NULL when unknown."""
    pairs = [F.lit(text) for item in COUNTRY_CODES.items() for text in item]
    return F.create_map(*pairs)[_col(country)]


def sampling_point_status(end_date: Column | str) -> Column:
    return F.when(_col(end_date).isNull(), "active").otherwise("closed")


def clean_station_name(name: Column | str) -> Column:
    """Title case without quotes and line breaks."""
    return F.initcap(F.regexp_replace(_col(name), "[\"\\n\\r]", ""))
