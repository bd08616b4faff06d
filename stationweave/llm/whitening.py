"""Whitening of embeddings with weights for repeated vectors.

Entries become whole numbers, ``floor(scale * c) + offset``, so that equal vectors can be grouped and sums are exact.

1. One Arrow pass turns vectors into whole numbers and a 256-bit digest of them; rows of equal digests are counted with a
   map-side sum, which leaves one row per distinct vector however often it repeats.
2. Each task centres its distinct vectors by the exact mean, multiplies them by their weights in one matrix product per
   batch and hands on one triangle of sums; Spark adds the triangles by position, so the driver gets d * (d + 1) / 2 numbers.
3. The eigenvectors of that matrix whiten each distinct vector once; rows get the result by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.llm._common import prepare, written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
# An eigenvalue below this share of the largest one counts as zero; its direction can't be scaled to variance 1.
RANK_TOLERANCE = 1e-12


def _lists(column: pa.Array, wanted: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose list is usable (not null or empty, all entries finite, ``wanted`` long) and their entries by row."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    values = column.values.slice(ends[0], ends[-1] - ends[0])
    flat = values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = np.diff(bad[ends - ends[0]]) == 0
    usable &= (sizes > 0) & ~column.is_null().to_numpy(zero_copy_only=False)
    if wanted is not None:
        usable &= sizes == wanted
    if wanted is None or not usable.any():
        return usable, np.zeros((0, wanted or 0))
    starts = (ends[:-1] - ends[0])[usable]
    return usable, flat[starts[:, None] + np.arange(wanted)]


def _whole(entries: np.ndarray, scale: int, offset: int) -> np.ndarray:
    """Entries as whole numbers; beyond 2 ** 62 they stay there."""
    return np.clip(np.floor(entries * scale), -2.0 ** 62, 2.0 ** 62).astype(np.int64) + offset


@dataclass
class Whitening:
    """Mean and components of the fit list.

    ``n`` and ``sums`` are exact whole numbers; ``vectors`` has one unit eigenvector per row, by falling eigenvalue.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    offset: int

    def usable(self) -> np.ndarray:
        """Components whose variance isn't zero."""
        return self.values > RANK_TOLERANCE * max(self.values[0], 0.0) if len(self.values) else np.zeros(0, bool)


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as 64-bit numbers where they fit for sure, else as Python numbers."""
    if len(x) and max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array(sums, np.int64)


def _squares(d: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if d.dtype != object and len(d) and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def dimension(vectors: DataFrame, vector_column: str = "embedding") -> int | None:
    """The most frequent length of usable vectors, the smaller one of equally frequent ones; None if there are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            usable, _ = _lists(batch.column(0), None)
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)[usable]
            for size, n in zip(*np.unique(sizes, return_counts=True)):
                counts[int(size)] = counts.get(int(size), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                                         names=["size", "n"])

    row = (vectors.select(vector_column).mapInArrow(run, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "size").first())
    return row["size"] if row else None


def _numbered(vectors: DataFrame, size: int, id_column: str | None, vector_column: str, scale: int, offset: int) -> DataFrame:
    """Rows that take part: their digest and either their id or their whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, entries = _lists(batch.column(0), size)
            if not usable.any():
                continue
            x = np.ascontiguousarray(_whole(entries, scale, offset))
            digests = pa.array([hashlib.sha256(row.tobytes()).digest() for row in x], pa.binary())
            if id_column is None:
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays([digests, pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["digest", "x"])
            else:
                yield pa.RecordBatch.from_arrays([digests, batch.column(1).filter(pa.array(usable))], names=["digest", "id"])

    kept = [F.col(vector_column).alias("_v")] + ([] if id_column is None else [F.col(id_column).cast("long").alias("_id")])
    return vectors.select(*kept).mapInArrow(run, "digest binary, x array<long>" if id_column is None else "digest binary, id long")


def distinct_vectors(vectors: DataFrame, vector_column: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame | None:
    """One row per distinct vector: ``digest, x, times``, as a written table; None if no vector can be used."""
    prepare(vectors.sparkSession)
    size = dimension(vectors, vector_column)
    if size is None:
        return None
    return written(_numbered(vectors, size, None, vector_column, scale, offset).groupBy("digest").agg(
        F.first("x").alias("x"), F.count(F.lit(1)).alias("times")), "whiten-distinct")


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy().reshape(batch.num_rows, -1)


def fit(distinct: DataFrame, weights: str = "count", components: int = COMPONENTS, scale: int = SCALE,
        offset: int = OFFSET) -> Whitening:
    """Mean, covariance (divisor: the sum of weights) and its leading eigenvectors.

    ``weights`` is ``count``, each distinct vector as often as it is there, or ``one``, each once.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"unknown weights {weights}")
    weighted = distinct.select("x", (F.col("times") if weights == "count" else F.lit(1).cast("long")).alias("w"))
    # Sums of whole numbers are exact in decimals, whatever their size.
    summed = (weighted.select("w", F.posexplode("x").alias("i", "v")).groupBy("i")
              .agg(F.sum((F.col("v") * F.col("w").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("s")))
    sums = [int(r["s"]) for r in sorted(summed.collect(), key=lambda r: r["i"])]
    n = int(weighted.agg(F.sum("w")).first()[0])
    size = len(sums)
    rows, columns = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                centred = _exact(_matrix(batch, 0), n, sums).astype(np.float64) / n
                total += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(total[rows, columns])], names=["at", "v"])

    triangle = weighted.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    covariance = np.zeros((size, size))
    for r in triangle:
        covariance[rows[r["at"]], columns[r["at"]]] = covariance[columns[r["at"]], rows[r["at"]]] = r["v"] / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, values[order], vectors[:, order].T.copy(), float(np.trace(covariance)), scale, offset)


def whiten_distinct(distinct: DataFrame, model: Whitening) -> DataFrame:
    """``digest, times, deviation, deviation_exact, z`` per distinct vector, each whitened once, as a written table.

    ``deviation`` is the sum of (n * x - S) ** 2 over the dimensions and null where it exceeds 64 bits;
    ``deviation_exact`` has all its digits. Components without variance are null in ``z``.
    """
    usable = model.usable()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = model.vectors / np.sqrt(np.where(usable, model.values, 1.0))[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _exact(_matrix(batch, 0), model.n, model.sums)
            z = (d.astype(np.float64) / model.n) @ by.T
            deviation = _squares(d)
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            missing = np.broadcast_to(~usable, z.shape).ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()),
                 pa.array([str(v) for v in deviation]), pa.ListArray.from_arrays(ends, pa.array(z.ravel(), mask=missing))],
                names=["digest", "times", "deviation", "deviation_exact", "z"])

    return written(distinct.select("x", "digest", "times").mapInArrow(
        run, "digest binary, times long, deviation long, deviation_exact string, z array<double>"), "whiten-scaled")


def identity_error(scaled: DataFrame, model: Whitening, weights: str = "count") -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, over the components with variance."""
    usable = np.flatnonzero(model.usable()).tolist()
    if not usable:
        return 0.0
    w = F.col("times") if weights == "count" else F.lit(1)
    means = scaled.agg(*[(F.sum(F.col("z")[k] * w) / F.sum(w)).alias(f"m{k}") for k in usable]).first()
    centred = {k: F.col("z")[k] - means[f"m{k}"] for k in usable}
    found = scaled.agg(*[(F.sum(centred[a] * centred[b] * w) / F.sum(w) - float(a == b)).alias(f"e{a}_{b}")
                         for a in usable for b in usable if a <= b]).first()
    return float(max(abs(v) for v in found))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", weights: str = "count",
           components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per remaining row and component: ``<id>, component, n, deviation, deviation_exact, whitened, explained,
    identity_error``.

    Null and empty vectors and those with null, NaN or infinite entries are left out, and so are vectors whose length
    isn't the most frequent one. Rows without an id or with a repeated one keep their own values. There are at most as
    many components as dimensions; those without variance (a constant dimension, fewer distinct vectors than components)
    are null in ``whitened`` and don't count in ``identity_error``; ``explained`` is null if nothing varies. No usable
    vector gives no rows. Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    out = (f"{id_column} long, component int, n long, deviation long, deviation_exact string, whitened double, "
           "explained double, identity_error double")
    distinct = distinct_vectors(vectors, vector_column, scale, offset)
    if distinct is None:
        return spark.createDataFrame([], out)
    model = fit(distinct, weights, components, scale, offset)
    scaled = whiten_distinct(distinct, model)
    error = identity_error(scaled, model, weights)
    size = len(model.sums)
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
    rows = _numbered(vectors, size, id_column, vector_column, scale, offset)
    explained = F.array(*[F.lit(v).cast("double") for v in shares])
    return (rows.join(scaled, "digest").select("id", "deviation", "deviation_exact", F.posexplode("z").alias("at", "whitened"))
            .select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "deviation_exact", "whitened", F.get(explained, F.col("at")).alias("explained"),
                    F.lit(error).alias("identity_error")))
