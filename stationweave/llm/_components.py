"""Connected components by alternating star contraction."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.llm._common import settled, written


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of an edge table with columns ``a`` and ``b``.

    Returns ``node, root`` for nodes that have an edge to another node. Loops, repeated edges and both directions are
    accepted; rows with a null end are ignored; an empty table gives an empty result.

    Each round hangs neighbours on the smallest one around them (large star, then small star), so the rounds grow with
    the logarithm of the number of nodes. A node with very many edges only appears as a grouping key with map-side
    minimum and as a join key that adaptive execution splits.
    """
    return settled(edges.sparkSession, lambda: _contracted(edges), "components")


def _contracted(edges: DataFrame) -> DataFrame:
    known = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known = written(known, "edges")
    state = _state(known)
    while state[0]:
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        large = large.where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("_m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e")).select("e.*")
        known = written(small.where("a <> b").distinct(), "edges")
        following = _state(known)
        if following == state:
            break
        state = following
    return known.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(b, a) % 1000003"))).first())
