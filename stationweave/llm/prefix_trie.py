"""The trie of conversation prefixes: who shares which first turns, and what sharing saves.

A conversation is its path, 16 bytes of a digest per turn, and the words of its turns; texts stay behind where they are
read. Paths are sorted by ranges, so that the conversations below any node stand side by side, and cut into shards of a
bounded number of turns. Each shard writes its trie as balanced parentheses:

- ``Parentheses.findclose`` delimits the subtree of every node, by the least and largest excess of blocks of bits;
- the rank of opening-closing pairs counts leaves, and cumulative arrays in preorder give members and saved tokens.

What lies between a shard's first and last path is finished there. The two paths themselves, the shard's spines, may go on
in other shards: they are handed on with what hangs off each of their nodes, and the next level builds a trie of spines
alone, with those sums as weights, in far fewer shards, until one is left. Members that end at a spine node are handed on
in runs of joined ids, so that hashing a list that many shards share reads prepared bytes one after another.

One conversation is one row of about 24 bytes a turn, and one row is never cut: its turns have to fit into a task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stationweave.llm._common import prepare, small_side, width, words_of, written

DIGEST = 16
# Turns in a shard, ids in a run of members that end at a spine node, and spines in a shard of a later level.
SHARD_TURNS, RUN_IDS, SPINES = 1 << 18, 1 << 13, 512
_NONE = (1 << 63) - 1
_EMPTY = hashlib.sha256(b"").hexdigest()
_PARTS = ("convs", "least", "children", "leaves", "saved")
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
     ("parent_key", pa.binary()), ("own_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
     ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.binary()),
     ("words", pa.list_(pa.int64()))] + [(p, pa.list_(pa.int64())) for p in _PARTS]
    + [("shard", pa.int64()), ("run", pa.int64()), ("data", pa.binary())])
_NODE, _SPINE, _RUN = 0, 1, 2
_DDL = ("kind int, conv_id long, depth long, parent_conv_id long, parent_key binary, own_key binary, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, words array<long>, "
        + ", ".join(f"{p} array<long>" for p in _PARTS) + ", shard long, run long, data binary")


class Parentheses:
    """A balanced sequence of opening (1) and closing (0) parentheses with blocks of excess bounds."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        n = len(bits)
        padded = np.full(-(-n // self.BLOCK) * self.BLOCK, self.excess[-1] if n else 0, np.int64)
        padded[:n] = self.excess
        blocks = padded.reshape(-1, self.BLOCK)
        # Bounds of one block, of two neighbours, of four, and so on.
        self.bounds = [(blocks.min(axis=1), blocks.max(axis=1))]
        while len(self.bounds[-1][0]) > 1:
            low, high = (np.append(x, x[-1:]) if len(x) % 2 else x for x in self.bounds[-1])
            self.bounds.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        pair = np.zeros(n, np.int64)
        pair[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.concatenate([[0], np.cumsum(pair)])

    def _holds(self, level: int, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        low, high = self.bounds[level]
        inside = block < len(low)
        block = np.minimum(block, len(low) - 1)
        return inside & (low[block] <= target) & (target <= high[block])

    def _scan(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``start`` to the end of its block whose excess is the target, else -1."""
        found = np.full(len(start), -1, np.int64)
        rows, place = np.arange(len(start)), start.copy()
        end = np.minimum((start // self.BLOCK + 1) * self.BLOCK, len(self.bits))
        while len(rows):
            keep = place < end[rows]
            rows, place = rows[keep], place[keep]
            hit = self.excess[place] == target[rows]
            found[rows[hit]] = place[hit]
            rows, place = rows[~hit], place[~hit] + 1
        return found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first place behind it with one less excess than it has."""
        target = self.excess[opens] - 1
        inside = (opens + 1) % self.BLOCK != 0
        found = np.full(len(opens), -1, np.int64)
        found[inside] = self._scan(opens[inside] + 1, target[inside])
        rows = np.flatnonzero(found < 0)
        block, level = opens[rows] // self.BLOCK, np.full(len(rows), -1)
        place = block.copy()
        for k in range(len(self.bounds)):
            # Up: the neighbour to the right of a left child is the next to look into.
            seek = level < 0
            hit = seek & (place % 2 == 0) & self._holds(k, place + 1, target[rows])
            level[hit], block[hit] = k, place[hit] + 1
            place = np.where(seek & ~hit, place // 2, place)
        for k in range(len(self.bounds) - 1, 0, -1):
            # Down: the left child if it reaches the target, else the right one.
            here = level == k
            left = block * 2
            go = np.where(self._holds(k - 1, left, target[rows]), left, left + 1)
            block, level = np.where(here, go, block), np.where(here, k - 1, level)
        found[rows] = self._scan(block * self.BLOCK, target[rows])
        return found

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Pairs without anything between them from each opening to its closing parenthesis, by rank."""
        return self.pairs[closes] - self.pairs[opens]


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    return len(os.path.commonprefix([a, b])) // DIGEST


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[:depth * DIGEST], digest_size=DIGEST).digest()


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


class _Shard:
    """Builds the trie of rows that come in path order and gives its nodes, spines and runs."""

    def __init__(self, number: int, last: bool) -> None:
        self.number, self.last = number, last
        self.paths: list[bytes] = []
        self.depth, self.words, self.parent, self.row = [0], [0], [-1], [0]
        self.stack = [0]
        self.closes: list[int] = []
        self.opens: list[int] = []
        self.own: dict[str, list[int]] = {"convs": [0], "least": [_NONE], "children": [0], "leaves": [0], "saved": [0]}
        self.ends: dict[int, list[int]] = {}
        self.first_stack: list[int] = []

    def _walk(self, path: bytes, words: list[int]) -> None:
        row, depth = len(self.paths), len(path) // DIGEST
        shared = _common(self.paths[-1], path) if row else 0
        self.closes.append(len(self.stack) - 1 - shared)
        self.opens.append(depth - shared)
        del self.stack[shared + 1:]
        for d in range(shared, depth):
            node = len(self.depth)
            self.depth.append(d + 1)
            self.words.append(words[d])
            self.parent.append(self.stack[-1])
            self.row.append(row)
            self.stack.append(node)
        for name, empty in (("convs", 0), ("least", _NONE), ("children", 0), ("leaves", 0), ("saved", 0)):
            self.own[name] += [empty] * (depth - shared)
        self.paths.append(path)
        if not row:
            self.first_stack = self.stack.copy()

    def conversation(self, path: bytes, words: list[int], conv_id: int) -> None:
        self._walk(path, words)
        node = self.stack[-1]
        self.own["convs"][node] += 1
        self.own["least"][node] = min(self.own["least"][node], conv_id)
        self.ends.setdefault(node, []).append(conv_id)

    def spine(self, path: bytes, words: list[int], parts: dict[str, list[int]]) -> None:
        self._walk(path, words[1:])
        for name, values in parts.items():
            own = self.own[name]
            for node, value in zip(self.stack, values, strict=True):
                own[node] = min(own[node], value) if name == "least" else own[node] + value

    def finish(self) -> Iterator[pa.RecordBatch]:
        n = len(self.depth)
        runs = np.empty(2 * len(self.paths) + 2, np.int64)
        runs[0], runs[1:-1:2], runs[2:-1:2], runs[-1] = 1, self.closes, self.opens, len(self.stack)
        tree = Parentheses(np.repeat(np.append(np.resize([1, 0], len(runs) - 1), 0).astype(np.uint8), runs))
        opens = np.flatnonzero(tree.bits)
        closes = tree.findclose(opens)
        until = np.arange(n) + (closes - opens + 1) // 2

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[until] - total[:n]

        depth, words, parent = (np.array(x, np.int64) for x in (self.depth, self.words, self.parent))
        own = {name: np.array(values, np.int64) for name, values in self.own.items()}
        spine = np.zeros(n, bool)
        if not self.last:
            spine[self.first_stack], spine[self.stack] = True, True
        least = own["least"].tolist()
        for node in range(n - 1, 0, -1):
            if least[node] < least[self.parent[node]]:
                least[self.parent[node]] = least[node]
        least = np.array(least, np.int64)
        convs = below(own["convs"])
        childless = (until - np.arange(n) == 1)
        leaves = tree.leaves(opens, closes) - below(childless & (spine | (own["children"] > 0))) + below(own["leaves"])
        saved = below(np.where(spine, 0, (convs - 1) * words) + own["saved"])
        inner_child = parent[(parent >= 0) & ~spine]
        children = own["children"] + np.bincount(inner_child, minlength=n)
        yield from self._nodes(np.flatnonzero(~spine), depth, parent, spine, least, convs, children, leaves, saved)
        if spine.any():
            # What hangs off a spine node itself: its subtree less those of its spine children.
            sums = {"convs": convs.copy(), "leaves": leaves.copy(), "saved": saved.copy()}
            inner = np.flatnonzero(spine & (parent >= 0))
            for name, values in (("convs", convs), ("leaves", leaves), ("saved", saved)):
                np.subtract.at(sums[name], parent[inner], values[inner])
            yield from self._spines(words, sums | {"least": least, "children": children})
            yield from self._runs(spine)

    def _nodes(self, at, depth, parent, spine, least, convs, children, leaves, saved) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(at), 1 << 14):
            part = at[i:i + (1 << 14)].tolist()
            up = [self.parent[v] for v in part]
            named = [p >= 0 and not spine[p] for p in up]
            columns = {
                "kind": [_NODE] * len(part), "conv_id": least[part], "depth": depth[part], "n_convs": convs[part],
                "n_children": children[part], "n_leaves": leaves[part], "saved_tokens": saved[part],
                "parent_conv_id": [int(least[p]) if k else None for p, k in zip(up, named)],
                "parent_key": [_key(self.paths[self.row[v]], self.depth[p]) if p >= 0 and not k else None
                               for v, p, k in zip(part, up, named)]}
            if self.ends:
                columns["ends_sha256"] = [hashlib.sha256(",".join(map(str, self.ends[v])).encode()).hexdigest()
                                          if v in self.ends else _EMPTY for v in part]
            else:
                columns["own_key"] = [_key(self.paths[self.row[v]], self.depth[v]) for v in part]
            yield _batch(len(part), columns)

    def _spines(self, words: np.ndarray, parts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for path, stack in ((self.paths[0], self.first_stack), (self.paths[-1], self.stack)):
            fresh = np.array([v not in told for v in stack])
            if not fresh.any():
                continue
            told.update(stack)
            yield _batch(1, {"kind": [_SPINE], "path": [path], "words": [words[stack].tolist()]} | {
                name: [np.where(fresh, parts[name][stack], _NONE if name == "least" else 0).tolist()] for name in _PARTS})

    def _runs(self, spine: np.ndarray) -> Iterator[pa.RecordBatch]:
        for node, ids in self.ends.items():
            if spine[node]:
                key = _key(self.paths[self.row[node]], self.depth[node])
                for k, i in enumerate(range(0, len(ids), RUN_IDS)):
                    yield _batch(1, {"kind": [_RUN], "own_key": [key], "shard": [self.number], "run": [k],
                                     "data": [",".join(map(str, ids[i:i + RUN_IDS])).encode()]})


def _encode(shard_turns: int):
    """Shards of conversations (path, words, conv_id) that come in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, turns = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            for path, words, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None or turns >= shard_turns:
                    if shard is not None:
                        yield from shard.finish()
                    shard, number, turns = _Shard(number, last=False), number + 1, 0
                shard.conversation(path, words, conv_id)
                turns += len(words) + 1
        if shard is not None:
            yield from shard.finish()
    return run


def _merge(last: bool):
    """One shard of spines (path, words and the sums) for each task, in order of their paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for row in batch.to_pylist():
                shard = shard or _Shard(0, last)
                shard.spine(row["path"], row["words"], {p: row[p] for p in _PARTS})
        if shard is not None:
            yield from shard.finish()
    return run


def paths(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
          text_column: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, turns``, an array of (digest as hex text, words).

    Turns are in the order of their number, a missing one first; those that share a number are ordered by role and then
    by the digest of their text. A null role or text is empty. Rows without a conversation id belong to none.
    """
    prepare(conversations.sparkSession)
    role = F.coalesce(F.col(role_column), F.lit(""))
    text = F.coalesce(F.col(text_column), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    turn = F.struct(F.col(turn_column).alias("n"), role.alias("r"), digest.alias("d"), words_of(text).alias("w"))
    given = conversations.where(F.col(conv_column).isNotNull()).select(F.col(conv_column).cast("long").alias("conv_id"), turn.alias("_turn"))
    return given.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("_turn")), lambda x: F.struct(
        x["d"].alias("d"), x["w"].alias("w"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 3, **columns: str) -> DataFrame:
    """Conversations rebuilt on a shared start: the first h turns of conversation c - c % every, then their own from h on.

    h is the checksum of the decimal id modulo ``most + 1``. A start that isn't there has no turns. Returns ``conv_id,
    turns`` as ``paths`` does; a conversation may have no turns left.
    """
    own = written(paths(conversations, **columns), "conversations")
    starts = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_start"), F.slice("turns", 1, most).alias("_first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce("_first", F.slice("turns", 1, 0)), F.lit(1), h)
    return (own.join(starts, F.col("conv_id") - F.col("conv_id") % every == F.col("_start"), "left")
            .select("conv_id", F.concat(head, rest).alias("turns")))


def _hashed_runs(runs: DataFrame) -> DataFrame:
    """The hash of each node's whole list from its runs, which come in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for own_key, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if own_key != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own_key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(data)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())],
                                             names=["own_key", "_ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["own_key", "_ends"])

    return (runs.select("own_key", "shard", "run", "data").repartition(width(runs), "own_key")
            .sortWithinPartitions("own_key", "shard", "run").mapInArrow(run, "own_key binary, _ends string"))


_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, spines_in_shard: int = SPINES) -> DataFrame:
    """All nodes of the trie of ``conv_id, turns`` (as ``paths`` and ``rebuilt`` return them), the textless root included.

    Per node: ``conv_id``, the smallest member; ``depth``; ``parent_conv_id``, null for the root; ``n_convs`` members;
    ``n_children``; ``n_leaves``, childless nodes in its subtree; ``saved_tokens``, the words of last turns in its subtree
    times one less than their members; ``ends_sha256`` of the comma-joined ids of members that end there, ascending.
    Conversations without turns are members of the root. No conversations give no node.
    """
    if spines_in_shard < 4:
        raise ValueError("a shard hands on two spines, so it has to take at least four")
    prepare(conversations.sparkSession)
    hexed = F.array_join(F.transform("turns", lambda t: t["d"]), "")
    rows = written(conversations.select("conv_id", F.unhex(hexed).alias("path"), F.transform("turns", lambda t: t["w"]).alias("words")),
                   "trie-paths")
    dealt = rows.repartitionByRange(width(rows), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ground = written(dealt.select("path", "words", "conv_id").mapInArrow(_encode(shard_turns), _DDL), "trie-shards")
    spines, upper = ground.where(f"kind = {_SPINE}"), None
    while True:
        shards = -(-spines.count() // spines_in_shard)
        chosen = spines.select("path", "words", *_PARTS)
        dealt = chosen.repartition(1) if shards <= 1 else chosen.repartitionByRange(shards, "path")
        level = written(dealt.sortWithinPartitions("path").mapInArrow(_merge(shards <= 1), _DDL), "trie-spines")
        found = level.where(f"kind = {_NODE}")
        upper = found if upper is None else upper.unionByName(found)
        if shards <= 1:
            break
        spines = level.where(f"kind = {_SPINE}")
    hashes = small_side(written(_hashed_runs(ground.where(f"kind = {_RUN}")), "trie-ends"))
    upper = written(upper.drop("ends_sha256").join(hashes, "own_key", "left")
                    .withColumn("ends_sha256", F.coalesce("_ends", F.lit(_EMPTY))), "trie-upper")
    names = small_side(upper.select(F.col("own_key").alias("_key"), F.col("conv_id").alias("_parent")))
    every = ground.where(f"kind = {_NODE}").select(*_RESULT, "parent_key").unionByName(upper.select(*_RESULT, "parent_key"))
    return every.join(names, F.col("parent_key") == F.col("_key"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select(*_RESULT)


def _crc32(text: str) -> str:
    """The checksum of an ASCII text in SQL: eight shifts for each character."""
    steps = ", ".join(["-1"] * 8)
    return (f"(xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({text}, ''), "
            f"lambda x: [ascii(x)::BIGINT, {steps}]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE "
            "xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT))")


SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, t) AS turns FROM t GROUP BY conv_id),
cut AS (SELECT conv_id, turns, {_crc32('conv_id::VARCHAR')} % 4 AS h FROM own),
rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], a.turns[1:0]), a.turns[a.h + 1:]) AS p
    FROM cut a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
members AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM rebuilt),
nodes AS (
    SELECT p[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(CASE WHEN len(p) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
    FROM members GROUP BY ALL),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
valued AS (
    SELECT n.*, coalesce(c.n, 0) AS n_children,
           CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.k[n.d].t, '[^\\x20\\x09-\\x0D]+')) END AS own
    FROM nodes n LEFT JOIN children c ON n.k = c.k),
spread AS (SELECT k, own, n_children, unnest(range(0, d + 1)) AS e FROM valued),
sums AS (SELECT k[1:e] AS k, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM spread GROUP BY ALL)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN sums s ON v.k = s.k LEFT JOIN valued up ON v.d > 0 AND up.d = v.d - 1 AND up.k = v.k[1:v.d - 1]
"""
