"""Token ids of documents in binary shards, with Elias-Fano coded document boundaries.

Shard layout, little-endian:

    magic "SWTOK001" | ids, 2 or 4 bytes each | boundaries | document ids | footer

``boundaries`` is the Elias-Fano code of the id counts at the end of each document, within the shard. ``document ids``
codes the ids less the smallest one; documents without an id come first and are only counted. The footer is
``ids u64, documents u64, without id u64, smallest id i64, start of boundaries u64, bytes per id u64`` and the magic.

Texts are dealt to shards by ranges of the document id and encoded by the task that writes the shard, so that texts
cross the network once and ids never do. A task names its file after its attempt and reports it in the manifest; files
of lost attempts are never read. Readers take ids in slices, so a shard of any size is read in bounded memory.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window

from stationweave.llm._common import prepare, scratch, uri_of, width, worker_cache, written
from stationweave.llm.elias_fano import EliasFano
from stationweave.llm.word_ids import WordEncoder, batches_of_bytes, with_end

MAGIC = b"SWTOK001"
FOOTER = "<QQQqQQ8s"
FOOTER_BYTES = struct.calcsize(FOOTER)
# Ids read at once; a single longer document is read whole.
SLICE_IDS = 1 << 21
# Documents whose boundaries are selected at once.
SLICE_DOCUMENTS = 1 << 12

MANIFEST = "shard long, file string, documents long, ids long"


def write_token_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, id_column: str = "doc_id",
                       text_column: str = "text", shards: int | None = None, word_memo: bool = False) -> DataFrame:
    """Encode whole texts and write shards in ascending id order; returns the manifest, one row per shard.

    With ``word_memo`` each distinct word is encoded once per worker. That gives the same ids only for tokenizers that
    drop white space and never join across it; the caller says so. ``folder`` is a URI that all executors reach. The end id closes every document, also null and empty ones, which
    have no other id. Documents without an id come first; rows that repeat an id follow one another by a hash of
    their text. Other columns are ignored. An empty table gives an empty manifest. The manifest is a written table, so
    reading it again doesn't write the shards again.
    """
    prepare(docs.sparkSession)
    cut = "blanks" if word_memo else "whole"
    key = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_t"))
    order = ["_id", F.xxhash64("_t")]
    dealt = key.repartitionByRange(shards or width(docs), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder_{tokenizer_path}_{cut}", lambda: WordEncoder(tokenizer_path, cut))
        kind = "<u2" if encoder.id_bytes == 2 else "<u4"
        shard, store, path, out = TaskContext.get().partitionId(), None, "", None
        lengths, ids = [], []
        for batch in batches_of_bytes(batches, 1):
            if out is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                path = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                out = store.open_output_stream(path)
                out.write(MAGIC)
            counts, coded = with_end(*encoder.encode(batch.column(1)), end_id)
            out.write(coded.astype(kind).tobytes())
            lengths.append(counts.astype(np.uint64))
            ids.append(batch.column(0))
        if out is None:
            return
        ends = np.cumsum(np.concatenate(lengths))
        known = pa.chunked_array(ids).drop_null().to_numpy()
        least = int(known[0]) if len(known) else 0
        start = len(MAGIC) + int(ends[-1]) * encoder.id_bytes
        out.write(EliasFano.encode(ends).to_bytes())
        out.write(EliasFano.encode((known - least).astype(np.uint64)).to_bytes())
        out.write(struct.pack(FOOTER, int(ends[-1]), len(ends), len(ends) - len(known), least, start, encoder.id_bytes, MAGIC))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]),
             pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1])], pa.int64())],
            names=["shard", "file", "documents", "ids"])

    return written(dealt.mapInArrow(run, MANIFEST), "token-manifest")


class Shard:
    """Reads one shard: ``boundary(i)`` by select, ``documents()`` in slices."""

    def __init__(self, file: str) -> None:
        store, path = fs.FileSystem.from_uri(file)
        size = store.get_file_info(path).size
        self.source = store.open_input_file(path)
        if size < len(MAGIC) + FOOTER_BYTES or self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{file} is not a token shard")
        footer = self.source.read_at(FOOTER_BYTES, size - FOOTER_BYTES)
        self.ids, self.n, self.without, self.least, start, self.id_bytes, magic = struct.unpack(FOOTER, footer)
        if magic != MAGIC or start != len(MAGIC) + self.ids * self.id_bytes:
            raise ValueError(f"{file} is damaged")
        coded = self.source.read_at(size - FOOTER_BYTES - start, start)
        self.ends, at = EliasFano.from_bytes(coded)
        self.named, at = EliasFano.from_bytes(coded, at)
        if self.ends.n != self.n or self.named.n != self.n - self.without or at != len(coded):
            raise ValueError(f"{file} is damaged")

    def boundary(self, i: int) -> tuple[int, int]:
        """First id and the place after the last id of document ``i`` of the shard."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def read(self, first: int, last: int) -> np.ndarray:
        """Ids of the shard from ``first`` up to ``last``, as unsigned 32-bit numbers."""
        data = self.source.read_at((last - first) * self.id_bytes, len(MAGIC) + first * self.id_bytes)
        return np.frombuffer(data, "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def documents(self) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
        """Slices of (document ids, ends within the shard with the first start before them, id bytes).

        Boundaries and document ids come from select, a bounded number of documents at a time.
        """
        start = 0
        for i in range(0, self.n, SLICE_DOCUMENTS):
            j = min(self.n, i + SLICE_DOCUMENTS)
            ends = np.concatenate([[start], self.ends.select_range(i, j).astype(np.int64)])
            named = self.named.select_range(max(0, i - self.without), max(0, j - self.without)).astype(np.int64)
            names = [None] * max(0, min(j, self.without) - i) + (named + self.least).tolist()
            start, a = int(ends[-1]), 0
            while a < j - i:
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_IDS, side="right")) - 1)
                data = self.read(int(ends[a]), int(ends[b])).tobytes()
                cuts = ((ends[a:b + 1] - ends[a]) * 4).tolist()
                yield names[a:b], ends[a:b + 1], [data[x:y] for x, y in zip(cuts, cuts[1:])]
                a = b


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Read shards back: ``doc_id, start, n_tokens, ids`` per document.

    ``start`` counts the ids of all documents before it, ``n_tokens`` includes the end id, and ``ids`` holds
    little-endian unsigned 32-bit numbers. A missing or damaged shard raises an error.
    """
    prepare(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard; it is the only thing ordered in one place.
    placed = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for names, ends, parts in Shard(row["file"]).documents():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(ends[:-1] + row["_base"], pa.int64()),
                         pa.array(np.diff(ends), pa.int64()), pa.array(parts, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return placed.repartition(width(manifest)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the shards of ``docs`` to a fresh shared folder and read them back."""
    folder = uri_of(scratch(docs.sparkSession, "token-shards"))
    return read_token_shards(write_token_shards(docs, tokenizer_path, folder, **options))
