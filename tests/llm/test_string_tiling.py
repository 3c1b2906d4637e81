from __future__ import annotations

import random
import re
import time

import numpy as np

from customsloom.llm import string_tiling as gst
from tests.conftest import SF
from tests.llm.helpers import text


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def brute(item, doc, m):
    """Greedy tiling word by word."""
    a, b, used_a, used_b, total, tiles = words(item), words(doc), set(), set(), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < m:
            return total, tiles
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        total, tiles = total + n, tiles + 1


def test_tiles_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    items = [(i, text(i, rng.randint(6, 40))) for i in range(6)]
    for d in range(40):
        parts = [text(1000 + d, rng.randint(0, 30))]
        for i in rng.sample(range(6), 2):
            w = items[i][1].split()
            cut = rng.randint(0, len(w))
            parts += [" ".join(w[cut:]), text(2000 + d, rng.randint(0, 5)), " ".join(w[:cut])]
        rows.append((d, " ".join(parts)))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["tiles"]) for r in gst.matches(docs, bench, min_coverage=0.4).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            n, k = brute(x, t, gst.MIN_MATCH)
            if n and n >= 0.4 * len(words(x)):
                want[d, i] = (n, k)
    assert got == want and len(want) > 20


def test_reordered_passages_and_odd_rows(spark):
    item = text(7, 30)
    w = item.split()
    moved = " ".join(w[20:] + ["between"] + w[:10] + ["and"] + w[10:20])
    rows = [(1, f"Intro. {moved.upper()}!"), (2, text(8, 200)), (3, None), (4, ""), (None, item), (5, item), (5, item), (6, text(9, 40_000) + " " + item), (7, "one two")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, coverage string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, item)], "item_id bigint, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in gst.matches(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, None, 5, 5, 6) for i in (1, 4)], key=str)
    kept = gst.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 7]
    small = gst.matches(docs, bench, block_bytes=64)
    assert sorted(((r["doc_id"], r["item_id"]) for r in small.collect()), key=str) == got


def test_tiles_of_repeated_words_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a, b = [[rng.choice("xyz"[: rng.randint(1, 3)]) for _ in range(rng.randint(3, 40))] for _ in range(2)]
        code = lambda w: np.array([ord(x) * 0x9E3779B97F4A7C15 % 2**64 for x in w], np.uint64)
        tiles = gst.tile(code(a), code(b), 3)
        assert (sum(n for *_, n in tiles), len(tiles)) == brute(" ".join(a), " ".join(b), 3)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)


def test_long_texts_of_one_word_take_seconds(spark):
    docs = spark.createDataFrame([(1, "spam " * 1_000_000), (2, "spam eggs " * 300_000)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "spam " * 2_000), (2, "eggs " * 10 + "spam " * 10)], "item_id bigint, text string")
    began = time.monotonic()
    assert sorted((r["doc_id"], r["item_id"], r["covered_words"], r["tiles"]) for r in gst.matches(docs, bench).collect()) == [(1, 1, 2_000, 1), (1, 2, 10, 1)]
    assert time.monotonic() - began < 30


def test_short_items_are_found_anywhere_as_words_and_single_words_as_lines(spark):
    docs = [(1, "Two words."), (2, "First line here\n two WORDS \nlast line here"), (3, "these two words stand within"), (4, "two\nwords"), (5, "yes"), (6, None), (7, "Q: buy now?"), (8, "please buy now today, yes"), (9, "buy\nYes\nnow"), (10, "twotwo words buynow"), (11, "words two")]
    bench = [(1, "two words"), (2, "Yes!"), (3, "..."), (4, "two words"), (5, "buy now"), (6, "one two three four")]
    docs, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in gst.matches(docs, bench).collect()) == [(d, i) for d in (1, 2, 3, 4) for i in (1, 4)] + [(5, 2), (7, 5), (8, 5), (9, 2)]
    assert sorted(r["doc_id"] for r in gst.decontaminate(docs, bench).collect()) == [6, 10, 11]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert gst.matches(docs, bench).count() == 0 and gst.decontaminate(docs, bench).count() == 1
    assert gst.matches(docs.where("false"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_query_finds_planted_items(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in gst.matches(docs, bench).collect()}
    items = {r["item_id"]: " ".join(words(r["text"])) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t and f" {t} " in f" {' '.join(words(r['text']))} "}
    assert want <= got and np is not None
