"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders the shingles of every document; the k smallest form its sketch. Inverted lists over retained
values bring documents together, the k smallest of both sketches estimate their similarity, and the full shingle sets
decide. Documents with equal sets are one class from the start, so exact copies never meet each other in a list.

How each guard holds at scale:

- A value kept by more than ``HOT_LIST`` classes (a shared passage) would tie together documents that are not alike. A
  document posts its first ``KEYS`` values that are not of this kind. Where such values are more than three eighths
  of the sketch, it posts its first ``KEYS`` values of any kind as well. Two documents at the threshold share about 85
  of 100 values of their joint sketch, so they miss each other with a chance below 1e-7.
- Each list first compares its members with a few leaders only. Members already connected by that are not compared again.
  Lists that still hold several components are cut into bands of like set sizes and those into blocks of about
  ``BLOCK_VALUES`` values, and blocks of one band and the next meet in pairs: sets of other bands differ too much in size
  to be alike. So every remaining pair of a list that can be alike is looked at in bounded memory. Of a list of up to
  ``HOT_LIST`` members the pairs that the sketches support leave the task to be confirmed; in longer ones the full sets
  meet, and only links that connect something new leave the task.
- A row is known by its id and a hash of its text, so rows that repeat an id or have none are documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from stationweave.llm._common import prepare, settled, small_side, width, written
from stationweave.llm._components import components

SKETCH = 64
KEYS = 12
HOT_LIST = 64
# Members of a block at most, and the values that a block of full sets holds (more only if one set alone has more).
BLOCK, BLOCK_VALUES = 128, 1 << 18
# Members of a list that the others are compared with first; one is enough for a list of up to FEW.
LEADERS = 4
FEW = 8
# Six standard deviations of the estimate over 64 values at a similarity of 0.85.
SLACK = 0.27

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``. Fewer words than ``size`` make one shingle of all of them.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    span = min(size, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - span + 1, np.uint64(span))
        for i in range(span):
            part = hashed[i:len(words) - span + 1 + i]
            mixed = (mixed ^ (part * _ODD[i % 3] + np.uint64(i))) * _ODD[0]
            mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD[1]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed >> np.uint64(1)).astype(np.int64)


def fingerprint(shingles: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def features(docs: DataFrame, id_column: str, text_column: str, size: int, k: int = SKETCH) -> DataFrame:
    """``_id, _hash`` (of the text), ``_n`` (set size), ``_set`` (fingerprint of the set), ``_sketch`` (its k smallest hashes)."""
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text and one whole set at a time; a copied slice doesn't hold its set.
            lengths, prints, sketches = [], [], []
            for text in batch.column(1):
                whole = shingle_hashes(text.as_py(), size)
                lengths.append(len(whole))
                prints.append(fingerprint(whole))
                sketches.append(whole[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lengths, pa.int64()), pa.array(prints, pa.string()), _lists(sketches)],
                names=["_id", "_hash", "_n", "_set", "_sketch"])

    return docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t"), F.xxhash64(text_column).alias("_h")).mapInArrow(
        run, f"_id {kind.simpleString()}, _hash long, _n long, _set string, _sketch array<long>")


def _texts(docs: DataFrame, classes: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``_node, _set, _n, _text``: the text that stands for each class (``_node, _first, _hash, _set, _n``).

    It is found by its id and hash; a class all of whose rows lack an id by the hash alone, from one of them.
    """
    keyed = docs.select(F.col(id_column).alias("_first"), F.xxhash64(text_column).alias("_hash"), F.col(text_column).alias("_text"))
    columns = ["_node", "_set", "_n", "_text"]
    found = keyed.join(small_side(classes), ["_first", "_hash"]).select(*columns)
    nameless = classes.where("_first is null")
    if nameless.isEmpty():
        return found
    alone = keyed.where("_first is null").join(small_side(nameless.drop("_first")), "_hash").select(*columns)
    return found.unionByName(alone.dropDuplicates(["_node"]))


def full_sets(docs: DataFrame, nodes: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """``_node, _n, _values``: the whole sorted shingle set of each class in ``nodes``, from one of its texts."""
    texts = _texts(docs, nodes, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, size) for t in batch.column("_text").to_pylist()]
            own = np.array([fingerprint(s) == f for s, f in zip(sets, batch.column("_set").to_pylist())], dtype=bool)
            mask = pa.array(own, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_node").filter(mask), batch.column("_n").filter(mask),
                 _lists([s for s, o in zip(sets, own) if o])], names=["_node", "_n", "_values"])

    # Rows that repeat an id with the same text give the same set; one of them is enough.
    return texts.select("_node", "_n", "_set", "_text").mapInArrow(run, "_node long, _n long, _values array<long>").dropDuplicates(["_node"])


def _posts(classes: DataFrame) -> DataFrame:
    """Which class is found under which value: ``_v, _node``."""
    values = classes.select("_node", F.explode("_sketch").alias("_v"))
    hot = written(values.groupBy("_v").count().where(F.col("count") > HOT_LIST).select("_v"), "hot-values")
    touched = values.join(small_side(hot), "_v").groupBy("_node").agg(F.collect_list("_v").alias("_hot"))
    marked = classes.select("_node", "_sketch").join(touched, "_node", "left")
    none = F.array().cast("array<bigint>")
    cold = F.array_except("_sketch", F.coalesce("_hot", none))
    mostly_hot = F.size(cold) * 8 < F.size("_sketch") * 5
    keys = F.array_distinct(F.concat(F.slice(cold, 1, KEYS), F.when(mostly_hot, F.slice("_sketch", 1, KEYS)).otherwise(none)))
    return marked.select("_node", F.explode(keys).alias("_v"))


def _estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the k smallest values of both sketches that both hold."""
    joint = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(joint, F.array_intersect(a, b))) / F.size(joint)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str, text_column: str, size: int,
               percent: int, k: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are alike enough.

    The sketches of both sides drop most pairs. For the rest the two whole texts meet and their sets are counted.
    """
    def side(name: str) -> DataFrame:
        return classes.select(F.col("_node").alias(name), F.col("_n").alias(f"n_{name}"), F.col("_sketch").alias(f"s_{name}"))
    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .where(_estimate(F.col("s_a"), F.col("s_b"), k) >= percent / 100 - SLACK).select("a", "b"))
    near = written(near, "candidates")
    named = classes.select("_node", "_first", "_hash", "_set", "_n")
    wanted = written(near.select(F.explode(F.array("a", "b")).alias("_node")).distinct().join(named, "_node"), "wanted")
    texts = _texts(docs, wanted, id_column, text_column)
    met = (near.join(texts.select(F.col("_node").alias("a"), F.col("_set").alias("set_a"), F.col("_text").alias("x")), "a")
           .join(texts.select(F.col("_node").alias("b"), F.col("_set").alias("set_b"), F.col("_text").alias("y")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            one, other = [], []
            for row in batch.to_pylist():
                # Rows of one b follow one another; an id may have several texts, of which one is the class's own.
                if at != (row["b"], row["y"]):
                    at, held = (row["b"], row["y"]), shingle_hashes(row["y"], size)
                mine = shingle_hashes(row["x"], size)
                if fingerprint(mine) != row["set_a"] or fingerprint(held) != row["set_b"]:
                    continue
                shared = len(np.intersect1d(mine, held, assume_unique=True))
                if 100 * shared >= percent * (len(mine) + len(held) - shared):
                    one.append(row["a"])
                    other.append(row["b"])
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])

    return met.select("a", "b", "set_a", "set_b", "x", "y").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of the intersections of all sets with those from number ``cut`` on; memory is bounded in slices of values."""
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.zeros((len(sets), len(sets) - cut), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for start in range(0, len(known), 1 << 14):
        lo, hi = np.searchsorted(place, [start, start + (1 << 14)])
        table = np.zeros((len(sets), 1 << 14), dtype=np.float32)
        table[owner[lo:hi], place[lo:hi] - start] = 1
        shared += table @ table[cut:].T
    return shared


def spanning(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The pairs that connect something new, in order: no more than there are members."""
    parent = list(range(size))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    kept = []
    for x, y in pairs:
        a, b = top(x), top(y)
        if a != b:
            parent[a] = b
            kept.append((x, y))
    return kept


def _compare_blocks(pairs: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Pairs of different components in two blocks of one list.

    With ``whole`` the blocks hold full sets, the links are final and those that connect nothing new stay in the task.
    Else they hold sketches and every pair that shares enough of them is returned as a candidate.
    """
    need = percent / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = [], []
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                members = left if row["same"] else left + right
                comp = np.array([m["_root"] for m in members])
                if (comp == comp[0]).all():
                    continue
                sets = [np.array(m["_values"], dtype=np.int64) for m in members]
                cut = 0 if row["same"] else len(left)
                shared = shared_counts(sets, cut)
                n = np.array([m["_n"] for m in members], dtype=np.float64)
                if whole:
                    fit = 100 * shared >= percent * (np.add.outer(n, n[cut:]) - shared)
                else:
                    held = np.array([len(s) for s in sets], dtype=np.float64)
                    fit = 100 * np.minimum.outer(n, n[cut:]) >= percent * np.maximum.outer(n, n[cut:])
                    fit &= shared >= need * np.minimum.outer(held, held[cut:])
                fit &= comp[:, None] != comp[None, cut:]
                i, j = np.nonzero(fit)
                keep = i < j if row["same"] else i < cut
                found = list(zip(i[keep].tolist(), (j[keep] + cut).tolist()))
                for x, y in spanning(found, len(members)) if whole else found:
                    one.append(members[x]["_node"])
                    other.append(members[y]["_node"])
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])

    return pairs.select("left", "right", "same").mapInArrow(run, "a long, b long")


def _meet(members: DataFrame, name: str, percent: int, whole: bool) -> DataFrame:
    """Pair what can be alike in each list: ``left, right, same``.

    A list of sketches is short and one block. Lists of full sets are cut into bands of sizes and blocks: sets of a band are at most 100 / percent times as large as each other, so a set can only be like those of its own
    band and of the two beside it. A band's blocks hold so many members that their values stay bounded.
    """
    if not whole:
        listed = members.groupBy("_v").agg(F.collect_list(F.struct("_node", "_root", "_n", "_values")).alias("left"))
        return listed.select("left", F.lit(None).cast(listed.schema["left"].dataType).alias("right"), F.lit(True).alias("same"))
    # A little more than the ratio, so that rounding doesn't put two sets at the threshold two bands apart.
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    banded = members.withColumn("_band", F.floor(F.log("_n") / step))
    # The widest set of a band, so that a block's bytes are bounded by its members.
    counted = banded.groupBy("_v", "_band").agg(F.count(F.lit(1)).alias("_b"), F.max(F.size("_values")).alias("_w"))
    fits = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.col("_w"), F.lit(1)))))
    counted = counted.select("_v", "_band", F.ceil(F.col("_b") / fits).alias("_blocks"))
    blocks = (banded.join(counted, ["_v", "_band"])
              .withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")))
              .groupBy("_v", "_band", "_block").agg(F.collect_list(F.struct("_node", "_root", "_n", "_values")).alias("_members")))
    blocks = written(blocks, name)
    left = blocks.select("_v", F.col("_band").alias("_i"), F.col("_block").alias("_k"), F.col("_members").alias("left"))
    # A block meets those of its own band and, from the band below, those of the next.
    right = blocks.select("_v", F.col("_block").alias("_l"), F.col("_members").alias("right"), F.col("_band").alias("_j"),
                          F.explode(F.array("_band", F.col("_band") - 1)).alias("_i"))
    met = left.join(right, ["_v", "_i"]).where((F.col("_i") < F.col("_j")) | (F.col("_k") <= F.col("_l")))
    same = (F.col("_i") == F.col("_j")) & (F.col("_k") == F.col("_l"))
    return met.select("left", F.when(~same, F.col("right")).alias("right"), same.alias("same")).repartition(width(members))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: ``<id_column>, n_shingles, component_id, kept``.

    Rows are linked when ``100 * shared >= percent * union`` holds for their sets of ``shingle_words``-word shingles.
    ``component_id`` is the smallest id reachable by links, the row's own included; ``kept`` says that it is the row's
    own. Texts that are null or without words have an empty set, link with nothing and are kept. Rows that repeat an
    id are rows of their own: each gets the component of its own text, and those equal to it are kept. A row without an
    id takes the component of the rows that are like it and is then not kept; alone it has a null component and is
    kept. Other columns are ignored, whatever they are called. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    judged = settled(spark, lambda: _judged(docs, id_column, text_column, shingle_words, percent), "near-duplicates")
    result = judged.select(F.col("_id").alias(id_column), F.col("_n").alias("n_shingles"), "component_id")
    return result.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_column), F.col("component_id").isNull()))


def _judged(docs: DataFrame, id_column: str, text_column: str, shingle_words: int, percent: int) -> DataFrame:
    """One row per input row: ``_id, _hash, _n, component_id, _root``, the number of its component (null without words)."""
    spark = docs.sparkSession
    found = written(features(docs, id_column, text_column, shingle_words), "sketches")
    # The number of a class is part of the written table, so it stays the same however often the table is read.
    classes = written(found.where("_n > 0").groupBy("_set").agg(
        F.min(F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_hash")).alias("_one"), F.first("_n").alias("_n"),
        F.first("_sketch").alias("_sketch"))
        .select("_set", F.col("_one._id").alias("_first"), F.col("_one._hash").alias("_hash"), "_n", "_sketch")
        .withColumn("_node", F.monotonically_increasing_id()), "classes")
    confirm = lambda pairs: _confirmed(pairs, classes, docs, id_column, text_column, shingle_words, percent, SKETCH)

    posts = written(_posts(classes), "posts")
    leaders = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("_node", F.lit(i)).alias("h"), F.col("_node").alias("b")))["b"]
                                         for i in range(LEADERS)]))
    heads = posts.groupBy("_v").agg(leaders.alias("_leaders"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    heads = heads.withColumn("_leaders", F.when(F.col("_c") > FEW, F.col("_leaders")).otherwise(F.slice("_leaders", 1, 1)))
    star = (posts.join(heads, "_v").select(F.col("_node").alias("a"), F.explode("_leaders").alias("b")).where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = settled(spark, lambda: confirm(star), "links")
    roots = components(links)
    more = settled(spark, lambda: _crossing(posts, heads, roots, classes, docs, confirm, id_column, text_column, shingle_words, percent),
                   "more-links")
    roots = components(links.unionByName(more))
    lowest = (classes.join(roots, F.col("_node") == F.col("node"), "left")
              .select("_set", "_first", F.coalesce("root", "_node").alias("_root")))
    component = lowest.groupBy("_root").agg(F.min("_first").alias("component_id"))
    names = lowest.join(component, "_root").select("_set", "component_id", "_root")
    return found.select("_id", "_hash", "_n", "_set").join(names, "_set", "left").select(
        "_id", "_hash", "_n", F.when(F.col("_n") == 0, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), "_root")


def _crossing(posts: DataFrame, heads: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame,
              confirm: Callable[[DataFrame], DataFrame], id_column: str, text_column: str, shingle_words: int, percent: int) -> DataFrame:
    """Links between different components of the lists that the leaders left in several."""
    placed = posts.join(heads.select("_v", "_c"), "_v").join(roots, F.col("_node") == F.col("node"), "left").select(
        "_v", "_c", "_node", F.coalesce("root", "_node").alias("_root"))
    split = placed.groupBy("_v").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo <> _hi").select("_v")
    open_lists = written(placed.join(split, "_v", "left_semi"), "open-lists")
    short = open_lists.where(F.col("_c") <= HOT_LIST).join(classes.select("_node", "_n", F.col("_sketch").alias("_values")), "_node")
    crossed = _compare_blocks(_meet(short, "blocks", percent, whole=False), percent, whole=False).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = confirm(crossed)
    long = open_lists.where(F.col("_c") > HOT_LIST)
    if not long.isEmpty():
        nodes = classes.join(long.select("_node").distinct(), "_node", "left_semi").select("_node", "_first", "_hash", "_set", "_n")
        sets = full_sets(docs, small_side(written(nodes, "long-list-nodes")), id_column, text_column, shingle_words)
        links = links.unionByName(_compare_blocks(_meet(long.join(sets, "_node"), "whole-blocks", percent, whole=True), percent, whole=True))
    return links


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5,
               percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``, with its own columns.

    It is the one with the smallest id, rows without an id last; of several with that id the one whose text has the
    smallest hash. Of rows that repeat both id and text one stays, and which one is open. Rows without words all stay.
    """
    spark = prepare(docs.sparkSession)
    judged = settled(spark, lambda: _judged(docs, id_column, text_column, shingle_words, percent), "near-duplicates")
    alike = judged.where("_root is not null")
    key = F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_hash")
    first = alike.groupBy("_root").agg(F.min(key).alias("_first"))
    placed = alike.select("_root", "_id", "_hash", key.alias("_key")).join(first, "_root")
    gone = written(placed.where("_key <> _first").select("_id", "_hash").distinct(), "near-duplicates-gone")
    again = written(placed.where("_key = _first").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash"),
                    "near-duplicates-again")
    match = F.col(id_column).eqNullSafe(F.col("_id")) & (F.xxhash64(text_column) == F.col("_hash"))
    left = docs.join(small_side(gone), match, "left_anti")
    if again.isEmpty():
        return left
    repeated = small_side(again)
    return left.join(repeated, match, "left_anti").unionByName(
        left.join(repeated, match, "left_semi").dropDuplicates([id_column, text_column]))
