"""Packing token ids into sequences of a fixed capacity by minimum bin slack.

Documents are encoded whole and cut into full pieces and a tail below the capacity. What is packed is a count per tail
length, a table of at most ``capacity`` numbers however many documents there are, so the plan is made on the driver:

1. A window gets the longest length that is left. A subset-sum table, one bit per reachable sum, over the counts of the
   other lengths finds the multiset that fills the window closest to the capacity; it is read back as counts.
2. The window is repeated as often as the counts allow, so the plan grows with the lengths and not with the documents.
3. If the multiset leaves slack, the longest length that is left is cut: one piece fills the slack, the rest goes back as
   a tail of its own. What is left in the end, less than one window, is laid out in sequences whose lengths are powers of
   two. So no sequence needs padding, but for those where cutting is switched off.

Spark encodes, counts, ranks and places: every tail has a rank among the tails of its length (its rank in the task that
made it plus the counts of the tasks before), and the plan names what becomes of each range of ranks. Texts never cross
the network; ids cross it only if the table of counts per task and length is too large to be broadcast.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window

from stationweave.llm._common import prepare, small_side, worker_cache, written
from stationweave.llm.word_ids import WordEncoder, batches_of_bytes, with_end

CAPACITY = 2048
PIECES = "task long, doc_id long, start long, length long, doc_tokens long, local long, ids binary"
PLACED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
# Ranks fit into so many bits of the key that finds a plan's entry.
_RANK_BITS = 38


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, with at most ``counts`` of each, whose sum is largest without going over ``target``.

    ``reached[i]`` holds bit s if the i longest lengths can make the sum s. It stops at the first length that makes the
    target itself; going back, each length is used as seldom as the sum allows.
    """
    lengths = sorted((x for x, n in counts.items() if n > 0 and 0 < x <= target), reverse=True)
    mask, reached = (1 << target + 1) - 1, [1]
    for length in lengths:
        bits, left, step = reached[-1], min(counts[length], target // length), 1
        while left > 0:
            take = min(step, left)
            bits |= bits << take * length & mask
            left, step = left - take, step * 2
        reached.append(bits)
        if bits >> target & 1:
            break
    total, found = reached[-1].bit_length() - 1, {}
    for i in range(len(reached) - 1, 0, -1):
        length, used = lengths[i - 1], 0
        while not reached[i - 1] >> total & 1:
            total, used = total - length, used + 1
        if used:
            found[length] = used
    return found


@dataclass
class Plan:
    """Entries of the plan as columns, sorted by (length, cut, rank), and the number of sequences.

    An entry says: of the tails of ``length``, ranks ``first`` up to ``last``, the piece of ``size`` ids that starts at
    ``cut`` is number ``index + rank - first`` of its kind, ``each`` of which go into one sequence, from sequence
    ``sequence`` on and from ``offset`` on in each.
    """

    entries: np.ndarray
    sequences: int
    padding: int

    NAMES = ("length", "cut", "first", "last", "size", "index", "each", "sequence", "offset")

    def keys(self) -> np.ndarray:
        return self.key(self.entries[0], self.entries[1], self.entries[2])

    @staticmethod
    def key(length: np.ndarray, cut: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << 12 | cut) << _RANK_BITS | rank


def plan(counts: dict[int, int], capacity: int = CAPACITY, cutting: bool = True) -> Plan:
    """Sequences for so many tails of each length from 1 to ``capacity``.

    Without ``cutting`` tails stay whole and windows keep their slack. An empty table needs no sequence.
    """
    if not 1 <= capacity < 1 << 11 + 1 or any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to the capacity, and that at most 4095: {capacity}")
    left = {x: int(n) for x, n in counts.items() if n > 0}
    # Tails of one length in the order in which they are used: (length at first, cut, ranks from, ranks up to).
    queues = {x: deque([(x, 0, 0, n)]) for x, n in left.items()}
    entries: list[tuple] = []
    sequences = padding = 0

    def take(length: int, number: int, size: int, each: int, sequence: int, offset: int) -> None:
        """Place ``size`` ids of each of the next ``number`` tails of a length; what is left of them goes back."""
        index = 0
        left[length] -= number
        while index < number:
            origin, cut, first, last = queues[length].popleft()
            now = min(last - first, number - index)
            if first + now < last:
                queues[length].appendleft((origin, cut, first + now, last))
            entries.append((origin, cut, first, first + now, size, index, each, sequence, offset))
            if size < length:
                rest = length - size
                left[rest] = left.get(rest, 0) + now
                queues.setdefault(rest, deque()).append((origin, cut + size, first, first + now))
            index += now
        if not left[length]:
            del left[length]

    total = sum(x * n for x, n in left.items())
    while total > 0 and (total >= capacity or not cutting):
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        window = fill(rest, capacity - longest)
        window[longest] = window.get(longest, 0) + 1
        slack = capacity - sum(x * n for x, n in window.items())
        needs = dict(window)
        source = max((x for x, n in left.items() if n > window.get(x, 0)), default=0) if slack and cutting else 0
        if source:
            needs[source] = needs.get(source, 0) + 1
        copies = min(left[x] // n for x, n in needs.items())
        offset = 0
        for length, n in sorted(window.items(), reverse=True):
            take(length, copies * n, length, n, sequences, offset)
            offset += length * n
        if source:
            take(source, copies, slack, 1, sequences, offset)
        used = capacity - (0 if source else slack)
        padding += copies * (capacity - used)
        sequences, total = sequences + copies, total - copies * used
    # Less than a window is left: one sequence for each power of two in it.
    while total > 0:
        room = 1 << total.bit_length() - 1
        total, offset = total - room, 0
        while offset < room:
            fitting = [x for x in left if x <= room - offset]
            length = max(fitting) if fitting else max(left)
            size = min(length, room - offset)
            take(length, 1, size, 1, sequences, offset)
            offset += size
        sequences += 1
    table = np.array(sorted(entries), np.int64).reshape(-1, len(Plan.NAMES)).T.copy()
    return Plan(table, sequences, padding)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of numbers as binary values; ``lengths`` counts the numbers of each."""
    offsets = (np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_column: str = "doc_id",
           text_column: str = "text", cut: str = "whole") -> DataFrame:
    """Encode whole texts, close each with the end id and cut it into full pieces and a tail.

    One row per piece, as a written table: ``task, doc_id, start, length, doc_tokens, local, ids``; ``local`` counts the
    pieces of the same length that the task made before, ``ids`` has 2 or 4 bytes an id.
    """
    prepare(docs.sparkSession)
    chosen = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder_{tokenizer_path}_{cut}", lambda: WordEncoder(tokenizer_path, cut))
        kind, task = np.dtype("<u2" if encoder.id_bytes == 2 else "<u4"), TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches_of_bytes(batches, 1):
            counts, ids = with_end(*encoder.encode(batch.column(1)), end_id)
            parts = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), parts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
            length = np.minimum(capacity, counts[doc] - start)
            order = np.argsort(length, kind="stable")
            number = np.empty(len(order), np.int64)
            firsts = np.searchsorted(length[order], length[order], side="left")
            number[order] = np.arange(len(order)) - firsts
            local = made[length] + number
            made += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), task)), batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length),
                 pa.array(counts[doc]), pa.array(local), _binary(ids.astype(kind), length)],
                names=["task", "doc_id", "start", "length", "doc_tokens", "local", "ids"])

    return written(chosen.mapInArrow(run, PIECES), "pack-pieces")


def place(cut_pieces: DataFrame, capacity: int = CAPACITY, cutting: bool = True) -> DataFrame:
    """Give every piece of ``pieces`` a place; the plan may cut tails further.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``; ``ids`` holds little-endian unsigned 32-bit
    numbers. Every id of every document is in exactly one row.
    """
    spark = cut_pieces.sparkSession
    made = written(cut_pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    # At most one row per length is collected: the histogram that the plan needs.
    totals = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if max(totals.values(), default=0) >= 1 << _RANK_BITS:
        raise ValueError("too many pieces of one length")
    found = plan(totals, capacity, cutting)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = made.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut_pieces.join(small_side(shifts), ["task", "length"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("before") + F.col("local")).alias("rank"), "ids")
    held = spark.sparkContext.broadcast((found.keys(), found.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, entries = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy() for i in (2, 4))
            open_rows, cut, rounds = np.arange(len(length)), np.zeros(len(length), np.int64), []
            while len(open_rows):
                entry = np.searchsorted(keys, Plan.key(length[open_rows], cut, rank[open_rows]), side="right") - 1
                origin, at, first, last, size, index, each, sequence, offset = entries[:, entry]
                now = rank[open_rows]
                assert (origin == length[open_rows]).all() and (at == cut).all() and (now < last).all()
                number = index + now - first
                rounds.append((open_rows, cut, size, sequence + number // each, offset + number % each * size))
                open_rows, cut = open_rows[cut + size < length[open_rows]], (cut + size)[cut + size < length[open_rows]]
            row, cut, size, sequence, offset = (np.concatenate(x) for x in zip(*rounds))
            order = np.lexsort((cut, row))
            row, cut, size, sequence, offset = (x[order] for x in (row, cut, size, sequence, offset))
            ids = batch.column(5)
            bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
            data = np.frombuffer(ids.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
            kind = "<u2" if len(data) == 2 * int(length.sum()) else "<u4"
            picked = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), pa.array(batch.column(1).to_numpy()[row] + cut), pa.array(size),
                 batch.column(3).take(picked), pa.array(sequence), pa.array(offset),
                 _binary(data.view(kind).astype("<u4"), size)],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(run, PLACED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, id_column: str = "doc_id",
         text_column: str = "text", cut: str = "whole", cutting: bool = True) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` ids.

    Null and empty texts are the end id alone. Rows are packed one by one, also those without an id or that repeat one;
    other columns are ignored. Sequences shorter than the capacity have a power of two as length (with ``cutting``). Which
    of several tails of one length goes where follows the order of the input's partitions. An empty table gives no rows.
    """
    return place(pieces(docs, tokenizer_path, capacity, end_id, id_column, text_column, cut), capacity, cutting)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int | None = 0) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, ids``, little-endian unsigned 32-bit ids.

    Sequences are padded to the capacity, but for those whose length is a power of two; ``pad_id=None`` pads none. A
    group holds at most ``capacity`` ids.
    """
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("offset", "ids"))), F.lit(b"").cast("binary"),
                         lambda a, x: F.concat(a, x["ids"]))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    if pad_id is None:
        return out
    n = F.col("n_tokens")
    whole = n.bitwiseAND(n - 1) == 0
    return out.withColumn("ids", F.when(whole, F.col("ids")).otherwise(_padded(F.col("ids"), n, capacity, pad_id)))


def _padded(ids: Column, n: Column, capacity: int, pad_id: int) -> Column:
    one = F.lit(pad_id.to_bytes(4, "little").hex())
    return F.concat(ids, F.unhex(F.repeat(one, (capacity - n).cast("int"))))
