"""Repeated words, hot payloads and clashing column names in the training-data operators."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from stationweave.llm import decontamination, hilbert_shards, line_templates, mixing, warc

from tests.llm.test_llm import plain_tiles, prose


def test_window_hashes_by_prefixes():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    base = int(decontamination._BASE)
    for size in (1, 5, 59, 60):
        want = [sum(int(w) * base ** (size - 1 - i) for i, w in enumerate(words[p:p + size])) % (1 << 64) for p in range(61 - size)]
        assert decontamination.window_hashes(words, size).tolist() == want
    assert len(decontamination.window_hashes(words, 61)) == 0


def test_tiles_of_repeated_words():
    rng = random.Random(5)
    for letters in (1, 2):
        for _ in range(40):
            text = [rng.randrange(letters) for _ in range(rng.randrange(60))]
            item = [rng.randrange(letters) for _ in range(rng.randrange(25))]
            got = decontamination.greedy_tiles(np.array(text, np.uint64) + np.uint64(1), np.array(item, np.uint64) + np.uint64(1), 3)
            assert got == plain_tiles(text, item, 3)
    start = time.perf_counter()
    block = decontamination.Block.of([("i", "again " * 2000), ("j", "once again " * 1000)], 5)
    found = dict(block.find(decontamination.word_hashes("again " * 300_000 + "once again " * 200)))
    assert found[0] == [(0, 0, 2000)]
    assert decontamination.coverage(2000, found[1]) >= 0.19
    # 800 x 8 000 such words took 58 seconds when every pair of equal windows was listed.
    assert time.perf_counter() - start < 40


def test_warc_of_a_hot_payload(spark):
    """Most rows are one page; copies without an id, repeated rows of the smallest id and small copies among them."""
    hot, other, small = "h" * 150, "o" * 100, "s" * 99
    rows = [(i, hot) for i in range(5, 200)] + [(5, hot), (None, hot), (None, hot), (300, other), (None, other), (400, small), (401, small),
                                                (None, "n" * 120), (None, "n" * 120)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").repartition(4)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in warc.archive_table(pages).collect())
    first = {hot: 5, other: 300}
    want = Counter()
    for i, html in rows:
        to = first.get(html)
        to = None if to == i else to
        want[(i, "response" if to is None else "revisit", to, hashlib.sha256(html.encode()).hexdigest())] += 1
    assert got == want


def test_shards_beside_a_column_of_their_name(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", f"own{i}", "k", 7) for i in range(40)],
                                 "doc_id long, text string, lang string, source string, shard string, _key string, slot int")
    hilbert_shards.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert {r["count"] for r in back.groupBy("_shard").count().collect()} == {10}


def test_mix_of_repeated_rows_with_clashing_names(spark):
    names = ["_copies", "_rows", "_row", "_id", "_size", "_source", "copies", "size"]
    rng = random.Random(3)
    rows = [(i // 3, prose(rng, 5), "ab"[i % 2]) for i in range(30)] + [(50, "one two three", "a")] * 4
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = plain.withColumns({n: F.lit(f"own{n}") for n in names})
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert all(r[n] == f"own{n}" for r in got.collect() for n in names)
    assert got.count() == mixing.mixed(plain).count() > 0


@pytest.mark.parametrize("names", [["__gone", "__of", "__text"], ["__GONE", "___gone", "_id", "_text", "_lines", "_leaf"]])
def test_line_templates_with_clashing_names(spark, names):
    rows = [(i, f"This very line stands in many documents\nown{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    got = line_templates.drop_recurring(docs)
    assert got.columns == docs.columns
    assert sorted(r.text for r in got.collect()) == [f"own{i}" for i in range(4)]
    assert all(r[n] == n for r in got.collect() for n in names)
