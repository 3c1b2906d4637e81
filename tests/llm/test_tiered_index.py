from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from customsloom.llm import tiered_index
from tests.llm.helpers import WORDS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document against every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("first", [2, 40, 512])
def test_same_as_every_document_scored(spark, monkeypatch, first):
    monkeypatch.setattr(tiered_index, "FIRST", first)
    monkeypatch.setattr(tiered_index, "GROWTH", 4)
    rng = random.Random(5)
    skewed = [1 / (1 + i) for i in range(len(WORDS))]
    docs = [(i, " ".join(rng.choices(WORDS, skewed, k=rng.randint(1, 120)))) for i in range(600)]
    items = [(i, " ".join(rng.choices(WORDS, skewed if i % 2 else None, k=rng.randint(1, 30)))) for i in range(25)]
    items.append((99, docs[17][1]))
    got = tiered_index.rank(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows(got) == brute(docs, items)


def test_items_fall_through_only_where_they_lack_a_proof(spark, monkeypatch):
    monkeypatch.setattr(tiered_index, "FIRST", 8)
    monkeypatch.setattr(tiered_index, "GROWTH", 4)
    docs = [(i, ("common " * (1 + i % 7) if i % 3 == 0 else "") + (f"rare{i % 40} rare{i % 40} other{i % 40}" if i < 200 else f"w{i}")) for i in range(2000)]
    items = [(0, "rare3 other3 common"), (1, "common")]
    asked = tiered_index.item_terms(spark.createDataFrame(items, "item_id bigint, text string"))
    index = tiered_index.build(spark.createDataFrame(docs, "doc_id bigint, text string"), asked)
    found, opened = tiered_index.search(index, asked, 5)
    assert opened[0] == 2 and len(opened) > 1 and opened[-1] == 1  # the rare terms' item is proven by the first tier
    assert rows(found.withColumnsRenamed({"item": "item_id", "id": "doc_id"})) == brute(docs, items, 5)


def test_odd_rows(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "?! - ."), (4, "Grün GRÜN grün"), (4, "grün x"), (None, "grün x"), (5, "a" * 300_000 + " grün"), (6, "x " * 200_000), (7, "É é"), (8, "grün x")]
    items = [(1, "GRün x"), (1, "é"), (2, None), (3, ""), (None, "x"), (4, "absent"), (5, "É")]
    d = spark.createDataFrame([(*r, i, "c") for i, r in enumerate(docs)], "doc_id bigint, text string, term int, UID string")
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id bigint, text string, Term int")
    assert rows(tiered_index.rank(d, i)) == brute(docs, items)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.where("doc_id = 3"), i)):
        out = tiered_index.rank(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    monkeypatch.setattr(tiered_index, "MOST_TERMS", 1)  # more asked terms than are sent to the tasks
    assert rows(tiered_index.rank(d, i)) == brute(docs, items)
