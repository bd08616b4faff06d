"""Brute-force, round-trip and edge-case tests of the training-data operators on small tables."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from stationweave.llm import (_common, _components, decontamination, elias_fano, embedding_dedup, hilbert_shards, line_templates,
                              minhash_dedup, mixing, quality, queries, token_files, toxicity, warc)

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("size", T.LongType()), T.StructField("kept", T.StringType())])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") + str(rng.randint(0, 30)) for _ in range(n))


def table(spark, rows):
    """Rows of (id, text, source); further columns clash with names that operators return."""
    return spark.createDataFrame([(i, t, "en", s, 7, "x") for i, t, s in rows], DOCS).repartition(3)


def words(text):
    return (text or "").encode().lower().split()


def sets(text, size):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def reach(n, linked):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    base = prose(rng, 60)
    return [(1, base, "a"), (2, base, None), (3, base.replace("x", "q", 2), "b"), (4, None, "a"), (5, "", "b"), (6, " \n\t", None),
            (None, base, "a"), (None, None, None), (8, prose(rng, 9000), "c"), (9, "w" * 50_000, "c"), (10, base, "a"), (10, base, "a"),
            (11, "one two", "b"), (12, "One  two", "b"), (13, prose(rng, 50), "a")]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200)]
    pairs = {(min(e), max(e)) for e in edges}
    nodes = sorted({x for e in edges for x in e})
    roots = reach(len(nodes), lambda i, j: (nodes[j], nodes[i]) in pairs)
    got = dict(map(tuple, _components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {nodes[i]: nodes[r] for i, r in enumerate(roots) if i != r}
    assert _components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    rng = random.Random(2)
    values = [rng.randrange(50) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5)
    import pyspark.sql.functions as F
    got = {r.i: r.r for r in _common.ranked(df, [F.col("v"), F.col("i")], "r", "t").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(300), key=lambda i: (values[i], i))
    assert sorted(got.values()) == list(range(300))


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    """Families of copies with edits; list limits are lowered so that every path runs."""
    monkeypatch.setattr(minhash_dedup, "HOT_LIST", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    rng = random.Random(11)
    rows = []
    for _ in range(6):
        base = prose(rng, rng.choice([8, 40, 120, 400])).split()
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            rows.append((len(rows), " ".join(copy), "s"))
    all_sets = [sets(t, 3) for _, t, _ in rows]
    roots = reach(len(rows), lambda i, j: 100 * len(all_sets[i] & all_sets[j]) >= 85 * len(all_sets[i] | all_sets[j]))
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(table(spark, rows), shingle_words=3, percent=85).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(rows))] == [
        (len(all_sets[i]), roots[i], roots[i] == i) for i in range(len(rows))]


def test_near_duplicates_odd_rows(spark, odd_rows):
    got = minhash_dedup.near_duplicates(table(spark, odd_rows), shingle_words=3, percent=85).collect()
    assert len(got) == len(odd_rows)
    known = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert known[1][1:] == (1, True) and known[2][1:] == (1, False) and known[10][1:] == (1, False)
    assert known[4] == (0, 4, True) and known[5] == (0, 5, True) and known[6] == (0, 6, True)
    assert known[11] == (1, 11, True) and known[12] == (1, 11, False)
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, True)]
    kept = minhash_dedup.keep_first(table(spark, odd_rows), shingle_words=3, percent=85)
    assert kept.columns == DOCS.fieldNames() and {r.doc_id for r in kept.collect()} >= {1, 4, 5, 6, 8, 9, 11, 13}
    assert minhash_dedup.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_without_ids_and_with_one_id(spark):
    text = prose(random.Random(1), 60)
    near = text + " more"
    rows = [(None, text, "a"), (None, near, "a"), (5, near, "a"), (8, prose(random.Random(2), 60), "a")]
    got = minhash_dedup.near_duplicates(table(spark, rows), shingle_words=3, percent=85).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 5, False), (0, 5, False), (5, 5, True), (8, 8, True)]
    kept = minhash_dedup.keep_first(table(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [5, 8]
    for i in (None, 3):
        kept = minhash_dedup.keep_first(table(spark, [(i, text, "a"), (i, near, "a"), (i, text, "a")])).collect()
        assert [(r.doc_id, r.text in (text, near)) for r in kept] == [(i, True)]


def test_settled_deletes_what_was_made_on_the_way(spark, tmp_path):
    import os
    made = []

    def make():
        made.append(_common.written(spark.range(5), "inner"))
        inner = _common.settled(spark, lambda: _common.written(made[0], "deeper"), "nested")
        made.append(inner)
        return inner
    kept = _common.settled(spark, make, "outer")
    assert kept.count() == 5 and not _common._open
    assert all(not os.path.exists(f.removeprefix("file://")) for df in made for f in df.inputFiles())
    with pytest.raises(ValueError):
        _common.settled(spark, lambda: int("x"), "broken")
    assert not _common._open


def test_keep_first_leaves_one_of_repeated_rows(spark):
    text = prose(random.Random(1), 30)
    kept = minhash_dedup.keep_first(table(spark, [(1, text, "a"), (1, text, "a"), (2, text, "a")]))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, int), np.zeros(700, int), np.array([5]), np.sort(rng.integers(0, 10 ** 12, 3000)),
                   np.sort(rng.integers(0, 50, 2000)), np.array([0, 1 << 40, (1 << 63) + 5], dtype=np.uint64)):
        coded, end = elias_fano.EliasFano.from_bytes(b"pad" + elias_fano.EliasFano.encode(values).to_bytes(), 3)
        assert coded.values().tolist() == values.astype(np.uint64).tolist()
        assert [coded.select(i) for i in range(coded.n)] == values.astype(np.uint64).tolist()
    assert len(elias_fano.EliasFano.encode(np.arange(0, 10 ** 6, 100)).to_bytes()) < 10 ** 4 * 9 / 8 + 400
    with pytest.raises(ValueError):
        elias_fano.EliasFano.encode(np.array([2, 1]))


def test_token_files_round_trip(spark, odd_rows, monkeypatch):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [r for r in odd_rows if r[0] is not None] + [
        (-5, "It's  naïve don't <|endoftext|>x \x01 \x1c a\x01b 12,345 Ünïcödé é", "a"), (20, "\x1f\x85 ok", "b")]
    for memo in (True, False):
        monkeypatch.setattr(token_files, "SLICE_IDS", 50)
        got = sorted(token_files.token_table(table(spark, rows), path, end_id=1, word_memo=memo).collect())
        start = 0
        # Rows that repeat an id are the same text here, so their order doesn't show.
        for (i, text, _), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
            ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
            assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
            assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
            start += len(ids)
    nameless = token_files.token_table(table(spark, [(None, "a b", "s"), (3, "c", "s")]), path).collect()
    assert sorted((r.start, r.doc_id) for r in nameless)[0] == (0, None)
    assert token_files.token_table(table(spark, []), path).count() == 0


def test_token_shard_select_and_damage(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, [(i, "word " * i, "s") for i in range(700)])
    (row,) = token_files.write_token_shards(docs, path, f"file://{tmp_path}", shards=1).collect()
    shard = token_files.Shard(row.file)
    assert [shard.boundary(i) for i in (0, 1, 699)] == [(0, 1), (1, 3), (699 * 700 // 2, 700 * 701 // 2)]
    assert len(shard.read(*shard.boundary(10))) == 11
    file = row.file.removeprefix("file://")
    data = open(file, "rb").read()
    for broken in (data[:-9], data[:20], b"x" + data[1:]):
        open(file, "wb").write(broken)
        with pytest.raises(ValueError):
            token_files.Shard(row.file)


def test_toxicity_learns_grades():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        n = rng.choice([1, 2, 4, 7, 10, 14]) if bad else 0
        text = " ".join([rng.choice(["nastyish", "vilewords", "hateful"]) + rng.choice(["a", "b"]) for _ in range(n)]
                        + [prose(rng, 1) for _ in range(60)])
        rows.append((*toxicity.features_of(text), int(bad), text, n))
        labels.append(int(bad))
    grades = toxicity.graded([(w, n, y) for w, n, y, _, _ in rows])
    assert set(grades.tolist()) == {0, 1, 2, 3} and all((g > 0) == (y == 1) for g, y in zip(grades, labels))
    model = toxicity.fit([(w, n) for w, n, *_ in rows[:400]], grades[:400])
    assert (np.diff(model.thresholds) > 0).all()
    scores = [model.expected(t) for *_, t, _ in rows[400:]]
    flagged = [s >= toxicity.TOXIC_FROM for s in scores]
    assert np.mean([f == bool(y) for f, y in zip(flagged, labels[400:])]) > 0.97
    mean = {k: np.mean([s for s, r in zip(scores, rows[400:]) if r[4] == k]) for k in (0, 1, 4, 14)}
    assert mean[0] < mean[1] < mean[4] < mean[14]


def test_toxicity_odd_rows(spark, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (13, 0), (13, None)], "doc_id long, toxic int")
    docs = table(spark, odd_rows)
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert got.count() == len(odd_rows) and got.columns == [*docs.columns, "severity"]
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    empty = toxicity.train(docs, labels.limit(0))
    assert empty.weights == {} and toxicity.score(table(spark, []), empty).count() == 0


def plain_tiles(text, item, least):
    """Greedy string tiling by comparing every start with every start."""
    used_t, used_i, tiles = set(), set(), []
    while True:
        best = []
        longest = least - 1
        for p in range(len(text)):
            for i in range(len(item)):
                n = 0
                while (p + n < len(text) and i + n < len(item) and text[p + n] == item[i + n]
                       and p + n not in used_t and i + n not in used_i):
                    n += 1
                if n > longest:
                    longest, best = n, []
                if n == longest and n >= least:
                    best.append((p, i, n))
        if not best:
            return tiles
        for p, i, n in best:
            if not used_t & set(range(p, p + n)) and not used_i & set(range(i, i + n)):
                used_t |= set(range(p, p + n))
                used_i |= set(range(i, i + n))
                tiles.append((p, i, n))


def test_greedy_tiles_against_plain():
    rng = random.Random(8)
    for _ in range(60):
        text, item = [rng.randrange(4) for _ in range(rng.randrange(40))], [rng.randrange(4) for _ in range(rng.randrange(25))]
        as_words = lambda x: np.array(x, dtype=np.uint64) + np.uint64(1)
        assert decontamination.greedy_tiles(as_words(text), as_words(item), 3) == plain_tiles(text, item, 3)


def test_decontamination(spark, odd_rows, monkeypatch):
    rng = random.Random(9)
    item = prose(rng, 30).split()
    moved = " ".join([prose(rng, 40), *item[15:], prose(rng, 20), *item[:15], prose(rng, 10)]).upper()
    part = " ".join([prose(rng, 40), *item[:20], prose(rng, 20)])
    exact = " ".join([prose(rng, 500), *item])
    rows = [*odd_rows, (100, moved, "a"), (101, part, "a"), (102, exact, "b"), (102, exact, "b")]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, ""), (None, "one two"), (4, prose(rng, 20))],
                                  "item_id long, text string")
    for chars in (8_000_000, 100):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", chars)
        found = {r.doc_id: r for r in decontamination.contamination(table(spark, rows), bench).collect()}
        assert set(found) == {100, 102} and found[100].coverage == 1.0 and found[102].items == 1
        kept = decontamination.keep_clean(table(spark, rows), bench)
        assert kept.columns == DOCS.fieldNames() and kept.count() == len(rows) - 3
    shares = {r.doc_id: r.coverage for r in decontamination.tilings(table(spark, rows), bench).collect()}
    assert shares[101] == pytest.approx(20 / 30)
    assert decontamination.keep_clean(table(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontamination.keep_clean(table(spark, []), bench).count() == 0


def test_decontamination_of_short_items_and_missing_ids(spark, tmp_path):
    rng = random.Random(10)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(1, item), (2, "Golden Gate Bridge"), (3, "Οὐλυμπόνδε"), (4, "?!")], "item_id long, text string")
    rows = [(1, "over the golden gate - bridge it goes", "a"), (2, "the golden bridge and the gate of it", "a"), (3, "ἔβη οὐλυμπόνδε", "a"),
            (4, "Gate", "a"), (None, prose(rng, 9) + " " + item, "a"), (None, prose(rng, 50), "a"), (5, item, "a"), (5, prose(rng, 50), "a"),
            (6, None, "a"), (7, "", "a")]
    docs = table(spark, rows)
    tiles = {r.doc_id: [tuple(t) for t in r.tiles] for r in decontamination.tilings(docs.where("doc_id < 5"), bench, short_items=True).collect()}
    assert tiles == {1: [(2, 3)], 3: [(1, 1)]}
    assert sorted(r.text for r in decontamination.keep_clean(docs, bench, short_items=True).collect() if r.text) == sorted(
        rows[k][1] for k in (1, 3, 5, 7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id or 0, r.contaminated, r.kept, r.items) for r in queries.op1_decontamination(spark, str(tmp_path)).collect())
    assert got == [(0, False, True, 0), (0, True, False, 1), (1, True, False, 1), (2, False, True, 0), (3, True, False, 1),
                   (4, False, True, 0), (5, False, True, 0), (5, True, False, 1), (6, False, True, 0), (7, False, True, 0)]


def filled(sizes, weights, share):
    """Targets by sharing the excess again and again."""
    total, target, full = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in sizes if s not in full]
        target = {s: 2.0 * sizes[s] if s in full else rest * weights[s] / sum(weights[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(6)
    names = ["b", "a", None, "c", "é", "Z"]
    rows = [(i, prose(rng, rng.randint(0, 40)), rng.choice(names[:1] * 5 + names)) for i in range(400)]
    rows += [(900, "x y z", "a")] * 5 + [(None, "x y", None), (901, None, "only-empty"), (902, "", "b")]
    got = mixing.taken_words(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(words(t))) for i, t, _ in rows)
    order = sorted({s for *_, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in order}
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert mine[0].target == pytest.approx(want[s])
        assert all(r.taken == r.copies * r.size <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine) + 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(table(spark, rows[::-1])).collect()))
    mixed = mixing.mixed(table(spark, rows))
    assert mixed.columns == DOCS.fieldNames()
    assert mixed.count() == sum(r.copies for r in got)
    assert mixing.taken_words(table(spark, [])).count() == 0 and mixing.mixed(table(spark, [])).count() == 0


def test_mixing_keeps_expectation(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i < 200 else "b") for i in range(260)]
    docs = table(spark, rows).cache()
    taken = np.mean([[r.copies for r in sorted(mixing.taken_words(docs, seed=s).collect())] for s in range(12)], axis=0)
    rate = {r.source: r.target / r.source_size for r in mixing.taken_words(docs).collect()}
    for part, source in ((taken[:200], "a"), (taken[200:], "b")):
        assert abs(part.mean() - rate[source]) < 0.05


def test_embedding_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 5)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32).tolist() for _ in range(150)]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [0.0] * 15, [3.0, 1.0]]
    labels = [int(rng.integers(3)) for _ in vectors]
    labels[5] = None
    rows = [(i, v, x, "clash") for i, (v, x) in enumerate(zip(vectors, labels))]
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]

    def linked(i, j):
        if not (good[i] and good[j]) or labels[i] is None or labels[i] != labels[j] or len(vectors[i]) != len(vectors[j]):
            return False
        a, b = np.array(vectors[i]), np.array(vectors[j])
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    roots = reach(len(rows), linked)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    for i in range(len(rows)):
        n = sum(linked(i, j) for j in range(len(rows)) if j != i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, roots[i], roots[i] == i), i
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def plain_templates(docs):
    """The documented rules, in plain Python: texts without their recurring lines."""
    lines = []
    for i, text in docs:
        for k, raw in enumerate((text or "").split("\n") if text is not None else []):
            form = tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[\x20\x09-\x0D]+", raw) if t)
            if len(form) >= line_templates.LEAST_TOKENS:
                lines.append((i, k, (len(form), form[:line_templates.LEAD]), form))
    gone = set()
    for leaf in {x[2] for x in lines}:
        mine = [x for x in lines if x[2] == leaf]
        pairs = {(x[0], x[3]) for x in mine}
        keep = []
        for p in range(leaf[0]):
            counts = {}
            for _, f in pairs:
                counts[f[p]] = counts.get(f[p], 0) + 1
            token, n = max(counts.items(), key=lambda x: x[1])
            keep.append(token if 2 * n > len(pairs) and token != "<*>" else None)
        own = {f: None if sum(a == b for a, b in zip(f, keep)) >= line_templates.SIMILARITY * len(f) else f for _, f in pairs}
        for name in set(own.values()):
            if len({d for d, f in pairs if own[f] == name}) >= line_templates.LEAST_DOCUMENTS:
                gone |= {(x[0], x[1]) for x in mine if own[x[3]] == name}
    return {i: None if t is None else "\n".join(r for k, r in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def test_line_templates(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join([f"Posted by user{i} on  day {i} of the month", f"The same licence line for all {rng.choice(['kinds', 'sorts'])} of text here now ok",
                           prose(rng, 12), "short one", "", "Thing " * 6]), "s") for i in range(5)]
    rows += [(20, None, "s"), (21, "", "s"), (22, "x" * 40_000 + " a b c d", "s"), (23, "only here stands this line once", None)]
    want = plain_templates([(i, t) for i, t, _ in rows])
    got = line_templates.drop_recurring(table(spark, rows), dropped="n_dropped")
    assert got.columns == [*DOCS.fieldNames(), "n_dropped"]
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert "licence" not in want[0] and "Posted" not in want[0] and want[23] is not None
    assert line_templates.drop_recurring(table(spark, rows + [(None, rows[0][1], None)] * 2)).count() == len(rows) + 2
    assert line_templates.drop_recurring(table(spark, [])).count() == 0


def test_short_line_templates(spark, monkeypatch):
    rows = [(i, f"Les.\nAll rights reserved.\n\n \nPage {i}\nOwn{'x' * i} line\nEnd.", "s") for i in range(4)] + [(9, "Les.\nstays", "s")]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring(table(spark, rows), least_tokens=1).collect()}
    assert got[3] == "\n \nOwnxxx line" and got[9] == "stays"
    monkeypatch.setattr(line_templates, "LEAST_TOKENS", 1)
    assert got == plain_templates([(i, t) for i, t, _ in rows])


def test_line_templates_of_repeated_ids(spark):
    common = "This very line stands in many documents"
    rows = [(i, f"{common}\nfirst of {i}", "s") for i in range(3)]
    rows += [(0, f"clean text of another row\n{common}", "s"), (None, f"{common}\nno id", "s"), (None, "clean text without any id", "s")]
    got = line_templates.drop_recurring(table(spark, rows), dropped="n").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n) for r in got) == sorted(
        [(False, i, f"first of {i}", 1) for i in range(3)] + [(False, 0, "clean text of another row", 1), (True, 0, "no id", 1),
                                                              (True, 0, "clean text without any id", 0)])
    alone = [(None, f"{common}\n{'x' * i}", "s") for i in range(3)]
    assert {r.text for r in line_templates.drop_recurring(table(spark, alone)).collect()} == {"", "x", "xx"}


def test_warc_round_trip(spark):
    rng = random.Random(7)
    big = "<html>" + prose(rng, 300) + "\r\n\r\nä</html>"
    rows = [(5, "http://a/1", big), (3, "http://a/2\r\nx: y", big), (9, None, big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None),
            (6, "u", ""), (7, None, prose(rng, 40_000)), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.archive_table(pages).collect()
    assert len(got) == len(rows)
    known = {r.page_id: r for r in got}
    for i, _, html in rows:
        data = (html or "").encode()
        r = known[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = html == big and i != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == data
    assert warc.archive_table(pages.limit(0)).count() == 0


def test_warc_frames_and_damage():
    dictionary = b"".join(b"<p>common part %d</p>" % (i % 9) for i in range(400))
    stream = io.BytesIO()
    writer = warc.ArchiveWriter(stream, dictionary)
    bodies = [b"<p>common part 3</p>" * i for i in range(1, 5)]
    for i, body in enumerate(bodies):
        writer.add(warc.record_bytes(i, "http://x", body, hashlib.sha256(body).hexdigest(), None))
    data = stream.getvalue()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert [warc.parse_record(r)[1] for r in warc.read_archive(io.BytesIO(data))] == bodies
    for broken in (data[:-3], data[4:], data[:6], data[:-20] + b"\0" * 20):
        with pytest.raises(ValueError):
            [warc.parse_record(r) for r in warc.read_archive(io.BytesIO(broken))]
    good = warc.record_bytes(1, None, b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    for broken in (good.replace(b"abc\r\n", b"abd\r\n"), good.replace(b"WARC/1.1", b"XARC/1.1"), good[:-1],
                   good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def test_hilbert_index_is_a_curve():
    for dims, bits in ((2, 5), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = hilbert_shards.hilbert_index(grid, bits)
        assert sorted(index.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_hilbert_shards(spark, odd_rows, tmp_path):
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, prose(rng, rng.randint(1, 50)), rng.choice(["a", "b", None])) for i in range(90)]
    got = hilbert_shards.document_shards(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(16)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    few = hilbert_shards.document_shards(table(spark, rows[:3])).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert hilbert_shards.document_shards(table(spark, [])).count() == 0
    unique = table(spark, rows[15:])
    hilbert_shards.write_shards(unique, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 90


def test_quality_learns_from_one_passage():
    """One bad passage among good ones decides; the attention must find it."""
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(240):
        parts = [prose(rng, 100) for _ in range(rng.randint(1, 5))]
        bad = i % 2
        if bad:
            parts[rng.randrange(len(parts))] = " ".join(rng.choice(["###", "$$$", "|"]) for _ in range(100))
        texts.append(" ".join(parts))
        labels.append(1 - bad)
    bags, y = [quality.encode(t) for t in texts], np.array(labels, dtype=float)
    model = quality.fit(bags[:160], y[:160], 0.5, epochs=15)
    scores = np.array([model.score(b)[0] for b in bags[160:]])
    assert ((scores >= 0.5) == (y[160:] == 1)).mean() > 0.95
    assert model.score(bags[0])[1].sum() == pytest.approx(1.0)


def test_quality_encoding_covers_whole_texts():
    assert quality.encode(None).shape == (1, quality.FEATURES) and quality.encode(" \n").shape == (1, quality.FEATURES)
    text = "  " + prose(random.Random(1), 950)
    assert len(quality.encode(text)) == 10
    assert not np.array_equal(quality.encode(text)[-1], quality.encode(text + " ###")[-1])
    again = quality.encode("one two three " * 200)
    assert again[1:, 261].min() == 1.0 and again[0, 261] > 0.9


def test_quality_odd_rows(spark, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (13, 0), (13, None)], "doc_id long, quality int")
    docs = table(spark, odd_rows)
    got = quality.score(docs, quality.train(docs, labels))
    assert got.count() == len(odd_rows) and all(0 <= r.score <= 1 for r in got.collect())
    flat = quality.train(docs, labels.where("quality = 0"))
    assert len({r.score for r in quality.score(docs, flat).collect()}) == 1
    assert quality.score(table(spark, []), flat).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """The stages over a small folder, each against its own rule."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    item = prose(rng, 30)
    rows, toxic = [], {}
    for i in range(90):
        text = prose(rng, 80)
        toxic[i] = int(i % 6 == 0)
        if toxic[i]:
            text += " " + "nastyword vileword " * 5
        rows.append((i, text, rng.choice(["a", "b", "c"])))
    rows += [(100, rows[1][1], "a"), (101, prose(rng, 40) + " " + item, "b"), (102, None, "a"), (103, "", None)]
    fields = [f for f in DOCS.fields if f.name in ("doc_id", "text", "lang", "source", "size")]
    table(spark, rows).select(*[f.name for f in fields]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, held = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _common.written(stage(spark, docs, str(tmp_path)), f"test-{name}")
        held[name] = sorted(str(r.doc_id) for r in docs.collect())
    left = {str(i) for i, _, _ in rows} - {str(i) for i, y in toxic.items() if y}
    assert set(held["toxicity"]) == left
    assert set(held["near_dedup"]) == left - {"100"}
    assert set(held["decontamination"]) == left - {"100", "101"}
    assert set(held["mixing"]) <= set(held["decontamination"]) and held["token_files"] == held["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(held["token_files"])
