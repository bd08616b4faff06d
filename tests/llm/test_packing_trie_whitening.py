"""Brute-force and edge-case tests of packing, the prefix trie and whitening."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from stationweave.llm import packing, prefix_trie, queries, whitening, word_ids

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_word_encoder_gives_the_ids_of_whole_texts():
    from tokenizers import Tokenizer
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "Σ", "'s", "'", "1", "23", "½", ".", "!?", "<|endoftext|>", "́", "​",
             "\x1c", "\x85", "　", "中", "\U0001f600", "word", "don't", "\xa0", "--", "_", "﻿", " ", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", None, "x " * 5000]
    for file, cut in (("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "blanks"), ("byte_bpe_50k.json", "whole")):
        path = public_tokenizers.path(file)
        encoder = word_ids.WordEncoder(path, cut)
        plain = Tokenizer.from_file(path)
        for part in (texts[:1500], texts[1500:], texts[:10], []):
            counts, ids = encoder.encode(pa.array(part, pa.string()))
            want = [plain.encode(t or "", add_special_tokens=False).ids for t in part]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_word_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(word_ids, "MEMO_WORDS", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = word_ids.WordEncoder(path, "spaces"), word_ids.WordEncoder(path, "whole")
    for i in range(30):
        texts = pa.array([f"the same word {i * 7 + k} of{k} x{i}" for k in range(9)])
        got, want = encoder.encode(texts), whole.encode(texts)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()
        assert len(encoder.memo) < 50 + 40


def test_word_memo_takes_few_bytes_a_word(monkeypatch):
    import tracemalloc
    encoder = word_ids.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), "spaces")
    texts = [pa.array([" ".join(f"{k * 7919 % 1000003}q" for k in range(i, i + 5000))]) for i in range(0, 100000, 5000)]
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for text in texts:
        encoder.encode(text)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(encoder.memo) >= 100000 and held < 80 * len(encoder.memo)
    # Words of many bytes are bounded by their bytes.
    monkeypatch.setattr(word_ids, "MEMO_BYTES", 20000)
    for i in range(40):
        text = f"{i:03d}" + "ab" * 2000
        assert encoder.encode(pa.array([text]))[1].tolist() == encoder._direct([text])[0]
        assert encoder.memo.nbytes < 20000 + 5000


def test_word_memo_keeps_common_words(monkeypatch):
    monkeypatch.setattr(word_ids, "MEMO_WORDS", 50)
    encoder = word_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), "blanks")
    common = [f"c{k}x" for k in range(20)]
    for i in range(30):
        encoder.encode(pa.array([" ".join(common + [f"r{i}y{k}" for k in range(20)])]))
        memo = set(encoder.memo if isinstance(encoder.memo, dict) else encoder.memo.to_pylist())
        learnt = [w for w in common if w in memo]
        calls = []
        direct = encoder._direct
        monkeypatch.setattr(encoder, "_direct", lambda texts, f=direct: calls.extend(texts) or f(texts))
        encoder.encode(pa.array([" ".join(common)]))
        monkeypatch.setattr(encoder, "_direct", direct)
        assert len(learnt) == len(common) and not calls


def test_whole_texts_reach_the_tokenizer_in_parts(monkeypatch):
    encoder = word_ids.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), "blanks")
    texts = [f"{k}{word_ids._CUT}" + "ab cd " * 10000 for k in range(20)]
    direct = encoder._direct
    expected = [i for text in texts for i in direct([text])[0]]
    sizes = []
    monkeypatch.setattr(encoder, "_direct", lambda part: sizes.append(sum(len(t.encode()) for t in part)) or direct(part))
    counts, ids = encoder.encode(pa.array(texts))
    assert ids.tolist() == expected and len(counts) == 20
    assert max(sizes) <= (1 << 18) + 100000 < sum(sizes)


def test_batches_of_bytes_keep_all_rows():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 7)), pa.array([("x" * (j * 5 % 23)) if j % 4 else None for j in range(i, i + 7)])],
                                          names=["i", "t"]) for i in range(0, 70, 7)]
    out = list(word_ids.batches_of_bytes(iter(batches), 1, 40))
    assert [v for b in out for v in b.column(0).to_pylist()] == list(range(70))
    assert len(out) > 10 and all(b.num_rows for b in out)


def test_fill_against_all_multisets():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(0, 3) for _ in range(rng.randint(0, 4))}
        target = rng.randint(0, 30)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        found = packing.fill(counts, target)
        assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= target)
        assert all(0 < n <= counts[x] for x, n in found.items())


@pytest.mark.parametrize("cutting", [True, False])
def test_plan_places_every_id_once(cutting):
    rng = random.Random(1)
    for _ in range(120):
        capacity = rng.choice([8, 16, 64, 2048])
        counts = {rng.randint(1, capacity): rng.choice([1, 2, 5, 300]) for _ in range(rng.randint(0, 12))}
        made = packing.plan(counts, capacity, cutting)
        covered, used = collections.Counter(), collections.defaultdict(list)
        for length, cut, first, last, size, index, each, sequence, offset in made.entries.T.tolist():
            for rank in range(first, last):
                k = index + rank - first
                covered[length, rank] += size
                used[sequence + k // each].append((offset + k % each * size, size))
        assert len(covered) == sum(counts.values()) and all(n == length for (length, _), n in covered.items())
        assert set(used) == set(range(made.sequences))
        for pieces in used.values():
            at = 0
            for offset, size in sorted(pieces):
                assert offset == at
                at += size
            assert at <= capacity and (not cutting or at == capacity or at & (at - 1) == 0)
    many = packing.plan({x: 10 ** 9 for x in range(1, 2049)}, cutting=cutting)
    assert many.entries.shape[1] < 60_000
    with pytest.raises(ValueError):
        packing.plan({9: 1}, 8)


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("length", T.StringType()), T.StructField("task", T.LongType()), T.StructField("_id", T.LongType())])


def test_packing(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [None, "", " ", "word " * 3000, "same tail here"] + ["same tail here"] * 20 + [
        "".join(rng.choice(["a b", "cd\n", "  x", "é ", "1 2"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 7, 8) for i, t in rows], DOCS).repartition(5)
    for capacity, cutting, cut in ((64, True, "spaces"), (64, False, "whole"), (2048, True, "spaces")):
        packed = packing.pack(docs, path, capacity, cutting=cutting, cut=cut).checkpoint()
        got = packed.collect()
        want = collections.Counter()
        for i, t in rows:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
            want.update((i, len(ids), k, x) for k, x in enumerate(ids))
        have = collections.Counter()
        for r in got:
            ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
            assert len(ids) == r.length
            have.update((r.doc_id, r.doc_tokens, r.start + k, x) for k, x in enumerate(ids))
        assert have == want
        places = collections.defaultdict(list)
        for r in got:
            places[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
        assert set(places) == set(range(len(places)))
        whole = {r.sequence_id: r for r in packing.sequences(packed, capacity, pad_id=9).collect()}
        for s, parts in places.items():
            parts.sort()
            assert [o for o, *_ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
            n = sum(n for _, n, _ in parts)
            assert n == whole[s].n_tokens <= capacity
            if cutting:
                assert n == capacity or n & (n - 1) == 0
            padded = b"".join(x for *_, x in parts) + (b"" if n & (n - 1) == 0 else (9).to_bytes(4, "little") * (capacity - n))
            assert bytes(whole[s].ids) == padded
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_query(spark, tmp_path):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(5, "a short text"), (6, None), (7, "long " * 4100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_packing(spark, str(tmp_path)).collect()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


def test_parentheses():
    rng = random.Random(7)
    for n in (1, 2, 3, 40, 64, 65, 500, 3000):
        bits, open_at, close = [], [], {}
        left = n
        while left or open_at:
            if left and (not open_at or rng.random() < rng.choice([0.3, 0.5, 0.9])):
                open_at.append(len(bits))
                bits.append(1)
                left -= 1
            else:
                close[open_at.pop()] = len(bits)
                bits.append(0)
        # One outer pair, so that the sequence is a tree.
        tree = prefix_trie.Parentheses(np.array([1] + bits + [0], np.uint8))
        opens = np.flatnonzero(tree.bits)
        closes = tree.findclose(opens)
        assert closes.tolist() == [len(bits) + 1] + [close[o - 1] + 1 for o in opens[1:].tolist()]
        for o, c, k in zip(opens.tolist(), closes.tolist(), tree.leaves(opens, closes).tolist()):
            inside = tree.bits[o:c + 1]
            assert k == int(((inside[:-1] == 1) & (inside[1:] == 0)).sum())
    deep = prefix_trie.Parentheses(np.repeat(np.array([1, 0], np.uint8), 5000))
    assert deep.findclose(np.arange(5000)).tolist() == list(range(9999, 4999, -1))


def brute_trie(conversations):
    """Nodes of {conv_id: [(role, text)]} by definition."""
    members = collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for key, convs in members.items():
        below = [k for k in members if k[:len(key)] == key]
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        leaves = sum(not any(len(j) == len(k) + 1 and j[:len(k)] == k for j in members) for k in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(conversations[c]) == len(key)))
        out.add((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), sum(len(k) == len(key) + 1 for k in below),
                 leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuild(rows):
    own = collections.defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def conversation_rows(seed, n=130):
    """Few distinct turns, a hot conversation, long ones, turnless ones, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 == 3:
            continue
        hot = c % 3 == 0
        for turn in range(rng.choice([1, 1, 2, 3, 5]) if not hot else 4):
            text = f"hot turn {turn}" if hot else rng.choice(["a b", "", "c", "line\x0btwo", None])
            rows.append((c, turn if turn or c % 5 else None, rng.choice(["user", None]) if not hot else "user", text))
    rows += [(200 + 20 * k, i, "user", f"deep {i}") for k in range(2) for i in range(60)]
    rows += [(None, 1, "user", "nobody's"), (7, 1, "user", "again"), (7, 1, "user", "again")]
    rng.shuffle(rows)
    return rows


CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                              T.StructField("text", T.StringType()), T.StructField("path", T.LongType()), T.StructField("turns", T.LongType())])


@pytest.mark.parametrize("shard_turns,spines", [(1 << 18, 512), (9, 4), (1, 5), (40, 1000)])
def test_prefix_trie_against_its_definition(spark, shard_turns, spines):
    rows = conversation_rows(shard_turns)
    # Rows of one turn number with different texts are ordered by digest; here they don't differ.
    seen, unique = {}, []
    for c, n, r, t in rows:
        if seen.setdefault((c, n), (r, t)) == (r, t):
            unique.append((c, n, r, t))
    table = spark.createDataFrame([(*r, 1, 2) for r in unique], CONVERSATIONS).repartition(3)
    got = prefix_trie.nodes(prefix_trie.rebuilt(table), shard_turns, spines).collect()
    want = brute_trie(rebuild(unique))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_prefix_trie_of_little(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.nodes(prefix_trie.rebuilt(empty)).collect() == []
    # Conversation 21 keeps nothing if its start is absent and it is shorter than h.
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    one = spark.createDataFrame([(c, 0, "user", "x y", 1, 2)], CONVERSATIONS)
    assert [tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(one)).collect()] == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # A prefix of another conversation, and the same conversation under two ids.
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b c"), (3, 0, "u", "a"), (3, 1, "u", "b c")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], CONVERSATIONS)
    assert {tuple(r) for r in prefix_trie.nodes(prefix_trie.paths(table)).collect()} == brute_trie(
        {1: [("u", "a")], 2: [("u", "a"), ("u", "b c")], 3: [("u", "a"), ("u", "b c")]})


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("digest", T.LongType()), T.StructField("x", T.LongType())])


def vector_rows(seed=1, n=120, size=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.2, (n, size)) @ rng.normal(0, 1, (size, size))
    rows = [(i, [float(v) for v in base[i % 40 if i % 3 else 0]]) for i in range(n)]
    rows += [(None, rows[5][1]), (7, rows[9][1]), (900, None), (901, []), (902, [1.0] * (size - 1) + [None]), (903, [1.0] * (size - 1) + [math.nan]),
             (904, [math.inf] * size), (905, [0.0] * size), (906, [0.5] * (size - 1))]
    return rows


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_against_numpy(spark, weights):
    rows, size = vector_rows(), 12
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS).repartition(4)
    got = whitening.whiten(table, weights=weights).collect()
    kept = [(i, np.float32(v).astype(float)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([np.floor(1024 * v).astype(np.int64) + 100_000 for _, v in kept])
    fit = x if weights == "count" else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    z = (x - sums / n) @ vectors / np.sqrt(values)
    deviation = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    mine = collections.defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and r.deviation_exact == str(r.deviation)
        assert abs(r.explained / (values[r.component - 1] / np.trace(np.cov(fit.T.astype(float), bias=True))) - 1) < 1e-9
        mine[r.vec_id, r.component].append((r.deviation, r.whitened))
    theirs = collections.defaultdict(list)
    for (i, _), d, row in zip(kept, deviation, z):
        for k in range(8):
            theirs[i, k + 1].append((d, row[k]))
    assert set(mine) == set(theirs)
    for k in range(1, 9):
        sign = np.sign(mine[1, k][0][1] * theirs[1, k][0][1])
        for key in theirs:
            if key[1] == k:
                a, b = sorted(mine[key]), sorted((d, sign * w) for d, w in theirs[key])
                assert [d for d, _ in a] == [d for d, _ in b] and np.allclose([w for _, w in a], [w for _, w in b], atol=1e-8)


def test_whitening_of_little(spark):
    def of(vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, 1, 2, 3) for i, v in enumerate(vectors)], VECTORS)).collect()
    assert of([]) == [] and of([None, [], [None]]) == []
    (one,) = of([[0.5]])
    assert (one.component, one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 1, 0, None, None, 0.0)
    flat = of([[0.0, 1.0], [1.0, 1.0], [1.0, 1.0]])
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True}
    assert abs(sum(r.whitened for r in flat if r.component == 1)) < 1e-9
    # Entries far beyond 64-bit squares keep an exact deviation.
    big = of([[3.0e30, 0.0], [0.0, 0.0], [0.0, 1.0]])
    assert any(r.deviation is None for r in big)
    assert all(int(r.deviation_exact) >= 0 for r in big)


def test_queries_are_registered():
    assert {"op11_whitening", "op12_prefix_trie", "op13_packing"} <= set(queries.QUERIES)
