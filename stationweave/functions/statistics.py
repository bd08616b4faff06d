"""Aggregates chosen by name."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import Column

from stationweave.functions.columns import nan_inf_to_null

_MOMENTS = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sd": F.stddev_samp,
    "var": F.var_samp,
}
_QUANTILE = re.compile(r"quantile_(\d*\.?\d+)$")


def order_probability(name: str) -> float | None:
    """Probability of an order statistic ("median", "quantile_<p>"), None for a moment statistic."""
    if name == "median":
        return 0.5
    match = _QUANTILE.match(name)
    if match is None:
        return None
    p = float(match.group(1))
    if not 0 <= p <= 1:
        raise ValueError(f"quantile probability out of range: {name}")
    return p


def moment(name: str, value: Column) -> Column:
    """NULL-skipping aggregate Column for a moment statistic."""
    if name not in _MOMENTS:
        raise ValueError(f"unknown statistic: {name}")
    return nan_inf_to_null(_MOMENTS[name](value))


def check_names(names: list[str]) -> None:
    for name in names:
        if name not in _MOMENTS and order_probability(name) is None:
            raise ValueError(f"unknown statistic: {name}")
