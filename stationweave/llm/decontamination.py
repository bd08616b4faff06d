"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed, a run of ``MIN_MATCH`` equal words, are tiled: the longest common runs of
words that are still unmarked on both sides are found by Karp-Rabin hashes of windows, marked, and looked for again until
none of at least ``MIN_MATCH`` words is left. The share of the item's words under tiles is its coverage; tiles may lie in any
order, so a passage whose parts were moved around is still covered. An item at or above the threshold contaminates the
document. With ``short_items`` an item of fewer than ``MIN_MATCH`` words is one seed and must be found whole.

Words are lower-cased runs of letters and digits, so punctuation doesn't hide a match.

The benchmark is a stated query set. It is taken in blocks of bounded size, and each block meets all documents in one scan;
its seed table travels with the tasks. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from stationweave.llm._common import prepare

MIN_MATCH = 5
COVERAGE = 0.8
# Characters of benchmark text in one block; a block is what the driver and each task hold of the benchmark.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
# An odd number has an inverse modulo 2^64.
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each lower-cased word of a whole text; null and wordless texts have none."""
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in _WORD.findall((text or "").lower())], dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``size`` words, by prefix sums modulo 2^64."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        before = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * np.cumprod(np.full(len(words), _INVERSE)))])
        return (before[size:] - before[:-size]) * np.cumprod(np.full(len(words), _BASE))[size - 1:]


def _free_windows(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows without a marked word."""
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[size:] == before[:-size]) if len(marked) >= size else np.zeros(0, dtype=np.int64)


def greedy_tiles(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles ``(start in text, start in item, length)``, longest first; ties go to the earliest in the text, then the item.

    Both arguments are arrays of word hashes. Equal windows are checked word by word before they count.
    """
    tiles: list[tuple[int, int, int]] = []
    text_marked, item_marked = np.zeros(len(text), dtype=bool), np.zeros(len(item), dtype=bool)

    def same(p: int, i: int, size: int) -> bool:
        return np.array_equal(text[p:p + size], item[i:i + size])

    def matches(size: int) -> tuple[dict, list[tuple[int, int]]] | None:
        """Unmarked item windows by hash, and the unmarked text windows with such a hash, if any two are equal."""
        there = defaultdict(list)
        free = _free_windows(item_marked, size)
        for i, h in zip(free.tolist(), window_hashes(item, size)[free].tolist()):
            there[h].append(i)
        if not there:
            return None
        free = _free_windows(text_marked, size)
        hashes = window_hashes(text, size)[free]
        hit = np.isin(hashes, np.fromiter(there, dtype=np.uint64, count=len(there)))
        found = list(zip(free[hit].tolist(), hashes[hit].tolist()))
        return (there, found) if any(same(p, i, size) for p, h in found for i in there[h]) else None

    longest = min(len(item), len(text))
    while longest >= min_match:
        # A common run of some length has common runs of every smaller length, so the longest one is found by halving.
        low, high, found = min_match - 1, longest, None
        while low < high:
            middle = (low + high + 1) // 2
            if at := matches(middle):
                low, found = middle, at
            else:
                high = middle - 1
        if low < min_match:
            break
        # Each text window takes the first item window that is still free. Tiles of this round are equally long, so a window
        # that meets one holds it at its first or last word; a taken item window is never looked at again.
        there, starts = found
        taken: dict[int, int] = defaultdict(int)
        end = 0
        for p, h in starts:
            if p < end:
                continue
            places = there[h]
            while taken[h] < len(places) and (item_marked[places[taken[h]]] or item_marked[places[taken[h]] + low - 1]):
                taken[h] += 1
            # The first of them is equal but for a collision of hashes.
            for k in range(taken[h], len(places)):
                i = places[k]
                if not (item_marked[i] or item_marked[i + low - 1]) and same(p, i, low):
                    text_marked[p:p + low] = True
                    item_marked[i:i + low] = True
                    tiles.append((p, i, low))
                    end = p + low
                    break
        longest = low
    return tiles


def coverage(item_length: int, tiles: list[tuple[int, int, int]]) -> float:
    return sum(t[2] for t in tiles) / item_length if item_length else 0.0


@dataclass
class Block:
    """Items of one block with their seeds by number of words, each sorted by hash."""

    names: list
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple], min_match: int, short_items: bool = False) -> Block:
        words = [word_hashes(text) for _, text in rows]
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            if len(w) >= (1 if short_items else min_match):
                by_size[min(min_match, len(w))].append(k)
        seeds = {}
        for size, members in by_size.items():
            windows = [np.unique(window_hashes(words[k], size)) for k in members]
            hashes, owners = np.concatenate(windows), np.repeat(members, [len(x) for x in windows])
            order = np.argsort(hashes, kind="stable")
            seeds[size] = hashes[order], owners[order]
        return cls([n for n, _ in rows], words, seeds)

    def find(self, text: np.ndarray) -> list[tuple[int, list]]:
        """Tilings of the items that share a seed with the text: (item number, tiles)."""
        return sorted((x for size in self.seeds for x in self._find(text, size)), key=lambda x: x[0])

    def _find(self, text: np.ndarray, size: int) -> list[tuple[int, list]]:
        seeds, owners = self.seeds[size]
        hits = window_hashes(text, size)
        at = np.searchsorted(seeds, hits)
        at[at == len(seeds)] = 0
        found = np.flatnonzero(seeds[at] == hits)
        places: dict[int, list[int]] = defaultdict(list)
        for p in found.tolist():
            j = int(at[p])
            while j < len(seeds) and seeds[j] == hits[p]:
                places[int(owners[j])].append(p)
                j += 1
        out = []
        for owner, starts in sorted(places.items()):
            # A tile lies inside the words that seeds of this item cover; a gap keeps runs on both sides of it apart.
            covered = np.unique((np.array(sorted(set(starts)))[:, None] + np.arange(size)).ravel())
            breaks = np.flatnonzero(np.diff(covered) > 1) + 1
            kept = np.insert(text[covered], breaks, np.arange(1, len(breaks) + 1).astype(np.uint64))
            origin = np.insert(covered, breaks, -1)
            tiles = greedy_tiles(kept, self.words[owner], size)
            out.append((owner, [(int(origin[p]), i, n) for p, i, n in tiles]))
        return out


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``chars`` characters, by a hash of the item; each block is read on its own."""
    items = benchmark.select(F.col(item_column).alias("_i"), F.col(text_column).alias("_t")).where(F.length("_t") > 0)
    total = items.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = max(1, -(-total // chars))
    for b in range(blocks):
        yield sorted(map(tuple, items.where(F.pmod(F.xxhash64("_i", "_t"), F.lit(blocks)) == b).collect()),
                     key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def tilings(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            item_column: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
            short_items: bool = False) -> DataFrame:
    """One row per document row and item that share a seed: ``<id>, <item>, coverage, tiles``.

    ``tiles`` lists the words of the document under each tile as ``start, words``. Items of fewer than ``min_match`` words
    match nothing; with ``short_items`` each is one seed, so it is there whole or not at all. Null and empty texts
    share nothing. Repeated rows of either table are compared on their own. Other columns are ignored. Either table may be
    empty; so is then the result.
    """
    prepare(docs.sparkSession)
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    schema = f"_id {kind}, _item {item_kind}, coverage double, tiles array<struct<start:int,words:int>>"
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t"))

    def scan(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, items, shares, marks = [], [], [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    for owner, tiles in block.find(word_hashes(text)):
                        ids.append(r)
                        items.append(block.names[owner])
                        shares.append(coverage(len(block.words[owner]), tiles))
                        marks.append([{"start": p, "words": n} for p, _, n in sorted(tiles)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(items, _arrow(item_kind)),
                     pa.array(shares, pa.float64()),
                     pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())])))],
                    names=["_id", "_item", "coverage", "tiles"])
        return texts.mapInArrow(run, schema)

    found = None
    for rows in _blocks(benchmark, item_column, item_text, BLOCK_CHARS):
        part = scan(Block.of(rows, min_match, short_items))
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"_id": id_column, "_item": item_column})


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, id_column: str = "doc_id",
                  **options) -> DataFrame:
    """One row per contaminated id: ``<id>, items`` (how many items), ``coverage`` (the highest)."""
    hits = tilings(docs, benchmark, id_column=id_column, **options).where(F.col("coverage") >= threshold)
    item = options.get("item_column", "item_id")
    return hits.groupBy(id_column).agg(F.countDistinct(item).alias("items"), F.max("coverage").alias("coverage"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, text_column: str = "text",
               item_column: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH,
               short_items: bool = False) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, with their own columns.

    Each block of the benchmark filters what the blocks before it left; rows are judged by their own text.
    """
    prepare(docs.sparkSession)
    left = docs
    for rows in _blocks(benchmark, item_column, item_text, BLOCK_CHARS):
        block = Block.of(rows, min_match, short_items)

        def run(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [all(coverage(len(block.words[o]), t) < threshold for o, t in block.find(word_hashes(x)))
                         for x in batch.column(text_column).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
    return left
