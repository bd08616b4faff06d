"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Every source gets a target number of words; the rate of a source is its target over its size, and a document is taken
``rate`` times. The whole part of that is certain. The fractions are rounded by the pivotal method: two documents of a
source meet, words move from one to the other in a direction drawn so that both keep their expectation, as far as one of
them is whole; the other one meets the next document. The words that a source takes thus stay at its target, but for the
rounding of one last document.

Documents meet in buckets of about ``BUCKET``, each folded on its own. What is left of a bucket, one document, meets
those of ``FAN`` neighbouring buckets in the next level, and so on: a tree whose depth is the logarithm of the number of
buckets. Draws are hashes of the two documents, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stationweave.llm._common import prepare, ranked, settled, small_side, written

BUCKET = 96
FAN = 64
# The weights of sources in code point order, repeating; the words to take as a share of all; most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def words_in(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``_source, _source_size`` to ``_source, _source_size, _target, _rate``.

    Sources take the weights in code point order, null last. The words to take are shared by weight; a source stops at
    ``most`` times its size and the excess goes to the others by weight until none is above. All sums are of whole
    numbers, so they don't depend on the order of rows. A source without words has the target 0 and the rate 1.
    """
    listed = written(ranked(sizes, [F.col("_source").asc_nulls_last()], "_rank", "sources").withColumns({
        "_weight": F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")),
        "_cap": most * F.col("_source_size")}), "source-weights")
    total = (listed.agg(F.sum("_source_size")).first()[0] or 0) * share
    level, reached = 0.0, None
    while True:
        full = F.col("_weight") * F.lit(level) >= F.col("_cap")
        state = listed.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0)), F.sum(F.when(~full, F.col("_weight")).otherwise(0)),
                           F.count_if(full)).first()
        if state[2] == reached or not state[1]:
            break
        reached = state[2]
        level = (total - state[0]) / state[1]
    target = F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(level))
    rate = F.when(F.col("_source_size") > 0, F.least(F.lit(float(most)), target / F.col("_source_size"))).otherwise(1.0)
    return listed.select("_source", "_source_size", target.alias("_target"), rate.alias("_rate"))


def _fold(units: str, seed: int) -> Column:
    """Pivotal rounding of an array of units in order: ``cur`` is what is left, ``done`` the rounded ones."""
    give_cur, give_x = "(1 - s.cur.p) * s.cur.size", "x.p * x.size"
    take_cur, take_x = "s.cur.p * s.cur.size", "(1 - x.p) * x.size"
    draw = f"shiftrightunsigned(xxhash64({seed}L, s.cur.id, s.cur.size, x.id, x.size), 11) * {2.0 ** -53!r}D"
    # Words go to the current unit with the chance that keeps both expectations.
    to_cur = (f"{draw} * (least({give_cur}, {give_x}) + least({take_cur}, {take_x})) < least({take_cur}, {take_x})")
    cur_whole = f"if({to_cur}, {give_cur} <= {give_x}, {take_cur} <= {take_x})"

    def unit(side: str, p: str) -> str:
        return (f"named_struct('id', {side}.id, 'size', {side}.size, 'm', {side}.m, 'base', {side}.base, "
                f"'p', greatest(0D, least(1D, {p})))")
    left_x = unit("x", f"if({to_cur}, x.p - ({give_cur}) / x.size, x.p + ({take_cur}) / x.size)")
    left_cur = unit("s.cur", f"if({to_cur}, s.cur.p + ({give_x}) / s.cur.size, s.cur.p - ({take_x}) / s.cur.size)")
    done_cur, done_x = unit("s.cur", f"if({to_cur}, 1D, 0D)"), unit("x", f"if({to_cur}, 0D, 1D)")
    step = (f"if({cur_whole}, named_struct('cur', {left_x}, 'done', concat(s.done, array({done_cur}))), "
            f"named_struct('cur', {left_cur}, 'done', concat(s.done, array({done_x}))))")
    return F.expr(f"aggregate(slice({units}, 2, size({units})), named_struct('cur', {units}[0], 'done', "
                  f"slice({units}, 1, 0)), (s, x) -> {step})")


def copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
           weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 1) -> DataFrame:
    """How often each document is taken: ``_id, _source, _size, _rows, _copies, _source_size, _target``.

    One row per distinct (id, source, size); ``_rows`` of the table have it and share ``_copies`` between them, so
    repeated rows are dealt with one by one. Documents without words take no part in the exchange of words: their
    fraction is rounded by a hash. Null ids, sources and texts are values like others. An empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    return settled(spark, lambda: _decided(docs, id_column, text_column, source_column, weights, share, most, seed), "mix-decided")


def _decided(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: Sequence[int], share: float,
             most: int, seed: int) -> DataFrame:
    units = written(docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("_source"),
                                words_in(F.col(text_column)).alias("_size"))
                    .groupBy("_id", "_source", "_size").agg(F.count(F.lit(1)).alias("_rows")), "mix-units")
    sizes = units.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_rows")).alias("_source_size"),
                                         F.count(F.lit(1)).alias("_units"))
    targets = written(source_targets(sizes.select("_source", "_source_size"), weights, share, most), "source-targets")
    counts = sizes.select(F.col("_source").alias("_s"), F.ceil(F.col("_units") / BUCKET).alias("_buckets"))
    known = written(targets.join(counts, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
                    .withColumnRenamed("_source", "_of"), "source-rates")
    expected = F.col("_rows") * F.col("_rate")
    rated = (units.join(known, F.col("_source").eqNullSafe(F.col("_of")))
             .withColumns({"_base": F.floor(expected), "_p": expected - F.floor(expected)}))
    unit = F.struct(F.col("_id").alias("id"), F.col("_size").alias("size"), F.col("_rows").alias("m"),
                    F.col("_base").alias("base"), F.col("_p").alias("p"))
    open_units = (F.col("_p") > 0) & (F.col("_size") > 0)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id", "_source"), 11) * (2.0 ** -53)
    settled = rated.where(~open_units).select(
        "_source", unit.alias("u"), (F.col("_base") + (chance < F.col("_p")).cast("long")).alias("_copies"))

    level = rated.where(open_units).select(
        "_source", F.pmod(F.xxhash64("_id", "_size"), F.col("_buckets")).alias("_bucket"), unit.alias("u"))
    most_buckets = known.agg(F.max("_buckets")).first()[0] or 1
    depth = 1 + max(0, math.ceil(math.log(most_buckets, FAN)))
    parts = [settled]
    for k in range(depth):
        # From the longest document to the shortest, ties by a hash: what is left to chance in the end is a short one.
        order = F.array_sort(F.collect_list(F.struct((-F.col("u.size")).alias("s"), F.xxhash64(F.lit(seed + k), "u.id", "u.size").alias("h"),
                                                     F.col("u"))))
        grouped = level.groupBy("_source", "_bucket").agg(order.alias("_ordered"))
        folded = written(grouped.select("_source", "_bucket", F.expr("transform(_ordered, o -> o.u)").alias("_units"))
                         .select("_source", "_bucket", _fold("_units", seed + k).alias("_r")), "mix-level")
        parts.append(folded.select("_source", F.explode("_r.done").alias("u"))
                     .withColumn("_copies", F.col("u.base") + F.col("u.p").cast("long")))
        level = folded.select("_source", F.floor(F.col("_bucket") / FAN).alias("_bucket"), F.col("_r.cur").alias("u"))
    # The one fraction that is left of a source goes to the nearer whole number, which is off by half a document at most.
    parts.append(level.withColumn("_copies", F.col("u.base") + (F.col("u.p") >= 0.5).cast("long")))
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part.select("_source", "u", "_copies"))
    return (decided.join(known.select("_of", "_source_size", "_target"), F.col("_source").eqNullSafe(F.col("_of")))
            .select(F.col("u.id").alias("_id"), "_source", F.col("u.size").alias("_size"), F.col("u.m").alias("_rows"),
                    "_copies", "_source_size", "_target"))


def _share_of_row(number: Column, copies: str = "_copies", rows: str = "_rows") -> Column:
    """Copies of row ``number`` (from 1) among ``rows`` rows that share ``copies``."""
    even = F.floor(F.col(copies) / F.col(rows))
    return even + (number <= F.col(copies) - even * F.col(rows)).cast("long")


def taken_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                **options) -> DataFrame:
    """One row per row of ``docs``: ``<id>, <source>, size, source_size, target, copies, taken`` (words, repeats counted)."""
    decided = copies(docs, id_column, text_column, source_column, **options)
    rows = decided.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return rows.withColumn("copies", _share_of_row(F.col("_row"))).select(
        F.col("_id").alias(id_column), F.col("_source").alias(source_column), F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "copies",
        (F.col("copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
          **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns."""
    decided = copies(docs, id_column, text_column, source_column, **options)
    named = decided.withColumnsRenamed({c: f"__mix{c}" for c in decided.columns})
    keyed = docs.withColumn("__mix_words", words_in(F.col(text_column)))
    own = [keyed[c] for c in docs.columns]

    def met(decisions: DataFrame) -> DataFrame:
        return keyed.join(decisions, keyed[id_column].eqNullSafe(decisions["__mix_id"])
                          & keyed[source_column].eqNullSafe(decisions["__mix_source"])
                          & (keyed["__mix_words"] == decisions["__mix_size"]))

    # Decisions grow with the documents, so they meet them in a sorted join whatever the size and are never broadcast.
    dealt = met(named.where("__mix_rows = 1").hint("merge")).select(*own, "__mix_copies")
    # Rows that share an id, a source and a size are the exception; only they are numbered.
    several = named.where("__mix_rows > 1").select("__mix_id", "__mix_source", "__mix_size", "__mix_rows", "__mix_copies")
    if not several.isEmpty():
        key = ["__mix_id", "__mix_source", "__mix_size"]
        number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(text_column)))
        rows = met(small_side(several)).select(*own, *key, "__mix_rows", "__mix_copies", number.alias("__mix_row"))
        dealt = dealt.unionByName(rows.select(*docs.columns, _share_of_row(
            F.col("__mix_row"), "__mix_copies", "__mix_rows").alias("__mix_copies")))
    often = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))
    return dealt.where("__mix_copies > 0").withColumn("__mix_copy", often).select(*docs.columns)
