"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors are scaled to length one and rotated by one fixed random rotation; the rotated vector is split into ``BLOCKS``
blocks of dimensions. Two vectors whose squared distance is at most d differ by at most d / ``BLOCKS`` in one of the
blocks, so joining each block by that budget finds every pair; the budget of the cosine threshold t is 2 - 2t. A found pair
is confirmed by its cosine in double precision.

The range join of a block is a grid join: vectors are binned by the first two coordinates of the block, in cells as wide as
the budget's root, and only the same and touching cells meet. A cell is cut into chunks of about ``CHUNK`` vectors, chunks
meet in pairs, and each pair of chunks is reduced inside its task to a number of links per vector and to the links that
connect something new. So a cell that holds a third of all vectors is dealt over many tasks, and no pair leaves its task
but as a count. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.llm._common import prepare, width, written
from stationweave.llm._components import components
from stationweave.llm.minhash_dedup import spanning

BLOCKS = 4
CHUNK = 192
# Added to every budget: rotation and scaling are exact to about 1e-15 only. Confirmation is by the plain cosine.
MARGIN = 1e-9
SEED = 20_240_601


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def block_edges(size: int, blocks: int) -> list[tuple[int, int]]:
    """Dimensions of each block; fewer blocks than asked for where there are fewer dimensions."""
    blocks = max(1, min(blocks, size))
    cuts = [round(i * size / blocks) for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in double precision."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _binned(classes: DataFrame, threshold: float) -> DataFrame:
    """One row per class, block and cell: ``_label, _size, _block, _x, _y, _node, _mult, _vector``."""
    budget = max(2 - 2 * threshold, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_size").to_numpy()
            vectors = batch.column("_vector")
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                data = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                turned = data / np.linalg.norm(data, axis=1, keepdims=True) @ rotation(size)
                edges = block_edges(size, BLOCKS)
                cell = math.sqrt(budget / len(edges) + MARGIN)
                part = batch.take(pa.array(rows))
                for b, (start, end) in enumerate(edges):
                    x = np.floor(turned[:, start] / cell).astype(np.int32)
                    y = np.floor(turned[:, start + 1] / cell).astype(np.int32) if end - start > 1 else np.zeros(len(rows), np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(rows), b, np.int32)), pa.array(x), pa.array(y)],
                        names=[*part.schema.names, "_block", "_x", "_y"])

    kind = classes.schema["_vector"].dataType.simpleString()
    label = classes.schema["_label"].dataType.simpleString()
    return classes.select("_label", "_size", "_node", "_mult", "_vector").mapInArrow(
        run, f"_label {label}, _size int, _node long, _mult long, _vector {kind}, _block int, _x int, _y int")


def _compare(pairs: DataFrame, threshold: float) -> DataFrame:
    """Links of chunk pairs: rows ``a`` with ``n`` (vectors linked with a) and rows ``a, b`` that connect something new."""
    budget = max(2 - 2 * threshold, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, others, counts = [], [], []
            for r in range(batch.num_rows):
                size, block = batch.column("_size")[r].as_py(), batch.column("_block")[r].as_py()
                same = batch.column("same")[r].as_py()
                left = batch.column("left")[r].values
                right = left if same else batch.column("right")[r].values
                edges = block_edges(size, BLOCKS)
                share = budget / len(edges) + MARGIN

                def matrix(side: pa.StructArray) -> np.ndarray:
                    flat = side.field("_vector").flatten().to_numpy(zero_copy_only=False)
                    return flat.astype(np.float64).reshape(-1, size)
                a, b = matrix(left), matrix(right)
                turn = rotation(size)
                ua = a / np.linalg.norm(a, axis=1, keepdims=True) @ turn
                ub = b / np.linalg.norm(b, axis=1, keepdims=True) @ turn

                def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
                start, end = edges[block]
                # The product form finds pairs fast but rounds; the difference form, the same in every block, decides.
                found = near(ua[:, start:end], ub[:, start:end]) <= share + MARGIN
                if same:
                    found = np.triu(found, 1)
                i, j = np.nonzero(found)
                # A pair counts in the first block that finds it.
                for k, (first, last) in enumerate(edges[:block + 1]):
                    d = ua[i, first:last] - ub[j, first:last]
                    inside = np.einsum("ij,ij->i", d, d) <= share
                    chosen = inside if k == block else ~inside
                    i, j = i[chosen], j[chosen]
                if len(i) == 0:
                    continue
                linked = cosines(a[i], b[j]) >= threshold if len(i) else np.zeros(0, dtype=bool)
                i, j = i[linked], j[linked]
                nodes_a, nodes_b = left.field("_node").to_numpy(), right.field("_node").to_numpy()
                mult_a, mult_b = left.field("_mult").to_numpy(), right.field("_mult").to_numpy()
                for nodes, own, mult, there in ((nodes_a, i, mult_b, j), (nodes_b, j, mult_a, i)):
                    total = np.bincount(own, weights=mult[there], minlength=len(nodes))
                    for k in np.flatnonzero(total).tolist():
                        ones.append(int(nodes[k]))
                        others.append(None)
                        counts.append(int(total[k]))
                shift = 0 if same else len(nodes_a)
                for x, y in spanning(list(zip(i.tolist(), (j + shift).tolist())), len(nodes_a) + len(nodes_b)):
                    ones.append(int(nodes_a[x]))
                    others.append(int(nodes_b[y - shift]))
                    counts.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(others, pa.int64()),
                                              pa.array(counts, pa.int64())], names=["a", "b", "n"])

    return pairs.select("_size", "_block", "same", "left", "right").mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding",
                 label_column: str = "label") -> DataFrame:
    """One row per input row: ``<id>, n_links, component_id, kept``.

    Vectors are linked when their labels are equal and not null, their lengths are the same and their cosine in double
    precision is at least ``threshold``. Null, empty and zero vectors and those with a null or non-finite component link
    with nothing. ``n_links`` counts the other rows linked directly, equal vectors included; ``component_id`` is the
    smallest id reachable, the row's own included; ``kept`` says that it is the row's own. Rows that repeat an id are
    rows of their own. A row without an id takes part, has the component of what it is linked with, and is kept only
    where that is null. Other columns are ignored. An empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(label_column).alias("_label"), F.col(vector_column).alias("_vector"))
    sound = (F.col("_label").isNotNull() & F.col("_vector").isNotNull() & (F.size("_vector") > 0)
             & ~F.exists("_vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
             & F.exists("_vector", lambda v: v != 0))
    # Two hashes of the components name a class; equal names are equal vectors but for a chance of 2^-128 a pair.
    name = F.when(F.coalesce(sound, F.lit(False)), F.concat(
        F.hex(F.xxhash64("_label", "_vector")), F.hex(F.xxhash64(F.lit(SEED), "_label", "_vector"))))
    named = written(rows.withColumn("_name", name), "vectors")
    classes = written(named.where("_name is not null").groupBy("_name").agg(
        F.count(F.lit(1)).alias("_mult"), F.min("_id").alias("_first"), F.first("_label").alias("_label"),
        F.first("_vector").alias("_vector"))
        .withColumns({"_node": F.monotonically_increasing_id(), "_size": F.size("_vector")}), "vector-classes")

    binned = written(_binned(classes, threshold), "vector-cells")
    place = ["_label", "_size", "_block", "_x", "_y"]
    cells = binned.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_chunks"))
    chunks = written(binned.join(cells, place).withColumn("_chunk", F.pmod(F.xxhash64("_node", "_block"), F.col("_chunks")))
                     .groupBy(*place, "_chunk").agg(F.collect_list(F.struct("_node", "_mult", "_vector")).alias("_rows")), "vector-chunks")
    # Each pair of touching cells meets once: the cell itself and four of its eight neighbours.
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"))
                                 for x, y in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])).alias("_to")
    from_cell = chunks.select("_label", "_size", "_block", "_x", "_y", F.col("_chunk").alias("_i"), F.col("_rows").alias("left"), around)
    from_cell = from_cell.select("_label", "_size", "_block", (F.col("_x") + F.col("_to.dx")).alias("_x"),
                                 (F.col("_y") + F.col("_to.dy")).alias("_y"), "_i", "left",
                                 ((F.col("_to.dx") == 0) & (F.col("_to.dy") == 0)).alias("_own"))
    met = from_cell.join(chunks.withColumnRenamed("_rows", "right"), place).where(~F.col("_own") | (F.col("_i") <= F.col("_chunk")))
    same = F.col("_own") & (F.col("_i") == F.col("_chunk"))
    pairs = met.select("_size", "_block", same.alias("same"), "left", F.when(~same, F.col("right")).alias("right"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "32")
    found = written(_compare(pairs, threshold), "vector-links")
    prepare(spark)

    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("_linked"))
    roots = components(found.where("b is not null").select("a", "b"))
    placed = (classes.select("_name", "_node", "_mult", "_first").join(links, F.col("_node") == F.col("a"), "left").drop("a")
              .join(roots, F.col("_node") == F.col("node"), "left")
              .select("_name", "_mult", "_first", F.coalesce("_linked", F.lit(0)).alias("_linked"),
                      F.coalesce("root", "_node").alias("_root")))
    lowest = placed.groupBy("_root").agg(F.min("_first").alias("_component"))
    described = written(placed.join(lowest, "_root").select(
        "_name", (F.col("_mult") - 1 + F.col("_linked")).alias("_n"), "_component"), "vector-components")
    result = named.select("_id", "_name").join(described, "_name", "left").select(
        F.col("_id").alias(id_column), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("_name").isNull(), F.col("_id")).otherwise(F.col("_component")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_column), F.col("component_id").isNull()))
