"""Exact grouped quantiles that stay distributed when one group dominates.

Values are first counted per (group, value), which spreads a dominant group over the cluster. Groups with few
distinct values finish in the built-in ``percentile``. Larger groups are cut into value slices: slice totals give
the slice that holds each wanted rank, and only those slices are ordered. Slice bounds come from a sketch that only
balances the work; the result is exact for any bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

MAX_DISTINCT = 1_000_000
SLICES = 256


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    max_distinct: int = MAX_DISTINCT,
    slices: int = SLICES,
    count: str | None = None,
) -> DataFrame:
    """Interpolated (type 7) quantiles per group as the array column ``quantiles``; NULL values are skipped.

    Groups without any value do not appear. ``count`` names the frequency column of a table that already has one row
    per group and value.
    """
    keys = list(keys)
    present = df.where(F.col(value).isNotNull())
    counted = (present.select(*keys, F.col(value).alias("_v"), F.col(count).alias("_c")) if count else
               present.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    # Usually empty or short; whether it is broadcast is left to its size at run time.
    large = (counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
             .where(F.col("_distinct") > max_distinct).select(*keys))
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    direct = (counted.join(large, keys, "left_anti")
              .groupBy(*keys).agg(F.percentile("_v", probs, F.col("_c")).alias("quantiles")))
    rows = counted.join(large, keys, "left_semi")
    return direct.unionByName(_sliced(rows, keys, probabilities, slices))


def _sliced(rows: DataFrame, keys: list[str], probabilities: Sequence[float], slices: int) -> DataFrame:
    cuts = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_v", cuts, 10 * slices).alias("_bounds"))
    rows = rows.join(bounds, keys).withColumn(
        "_slice", F.size(F.filter("_bounds", lambda b: b < F.col("_v")))).drop("_bounds")

    # One row per slice and group, so both windows see at most ``slices`` rows of a group.
    order = Window.partitionBy(*keys).orderBy("_slice")
    totals = (rows.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_n"))
              .withColumns({"_stop": F.sum("_n").over(order), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
              .withColumn("_start", F.col("_stop") - F.col("_n")))

    def wanted(p: float) -> list[Column]:
        """The two neighbouring ranks of a probability."""
        h = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(h)
        return [F.struct(F.lit(float(p)).alias("p"), (h - low).alias("frac"), rank.alias("rank"))
                for rank in (low, F.least(low + 1, F.col("_total") - 1))]
    every = F.array(*[w for p in probabilities for w in wanted(p)])
    targets = (totals.withColumn("_wanted", F.filter(
        every, lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_stop"))))
        .where(F.size("_wanted") > 0).select(*keys, "_slice", "_start", "_wanted"))

    within = Window.partitionBy(*keys, "_slice").orderBy("_v")
    ranked = (rows.join(targets, [*keys, "_slice"])
              .withColumn("_end", F.col("_start") + F.sum("_c").over(within))
              .withColumn("_hit", F.explode(F.filter("_wanted", lambda w: (w["rank"] < F.col("_end")) & (
                  w["rank"] >= F.col("_end") - F.col("_c"))))))
    at = ranked.groupBy(*keys, F.col("_hit.p").alias("_p")).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_hit.frac").alias("_frac"))
    blended = F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))
    found = F.map_from_entries(F.collect_list(F.struct("_p", blended)))
    return (at.groupBy(*keys).agg(found.alias("_found"))
            .select(*keys, F.array(*[F.col("_found")[F.lit(float(p))] for p in probabilities]).alias("quantiles")))
