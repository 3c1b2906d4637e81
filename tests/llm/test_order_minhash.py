from __future__ import annotations

import collections
import random
import re

import numpy as np

from customsloom.llm import order_minhash as omh
from customsloom.llm.components import connected_components
from tests.llm.helpers import edited, text


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(rows):
    """Classes by linking all pairs of texts."""
    w = {k: words(t) for k, (_, t) in enumerate(rows)}
    parent = {k: k for k in w}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    grams = {k: [tuple(v[i : i + 5]) for i in range(len(v) - 4)] for k, v in w.items()}
    for a in w:
        for b in range(a):
            n = len(grams[a]) + len(grams[b])
            m = lcs(grams[a], grams[b]) if n else 0
            if w[a] and (w[a] == w[b] or n and m / (n - m) >= 0.8):
                parent[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    return sorted(((rows[k][0], min((i for i in ids[root(k)] if i is not None), default=None)) for k in w), key=str)


def test_classes_equal_brute_force(spark):
    rows, rng = [], random.Random(4)
    for g in range(12):
        base = text(g, rng.randint(30, 120))
        rows.append((len(rows), base))
        rows += [(len(rows) + j, edited(base, 100 * g + j, rng.choice([0.0, 0.01, 0.03, 0.1]))) for j in range(5)]
    rows += [(900, None), (901, ""), (902, "?!"), (903, "one two"), (904, "One, two!"), (905, "one two three"), (906, text(50, 9)), (907, text(50, 9) + " more"), (908, text(0, 40)[::-1]), (900, "x"), (3, rows[3][1]), (None, rows[0][1]), (None, "lonely words here"), (910, text(60, 3000)), (911, text(60, 3000) + " end")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, class_id int")
    got = sorted(((r["doc_id"], r["class_id"]) for r in omh.classes(docs).collect()), key=str)
    assert got == brute(rows)
    kept = omh.deduplicate(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count(rows[0][1]) == 1 and None in texts and "" in texts


def test_a_large_group_keeps_together(spark):
    base = text(77, 150)
    rows = [(i, edited(base, i, 0.012)) for i in range(300)] + [(1000 + i, text(5000 + i, 150)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(docs).collect()}
    grams = [np.array([hash(tuple(t.split()[i : i + 5])) & (2**63 - 1) for i in range(146)], np.uint64) for _, t in rows[:300]]
    reached, todo = {0}, [0]
    while todo:  # all links, by exact similarity
        a = todo.pop()
        new = [b for b in range(300) if b not in reached and omh.similarity(grams[a], grams[b])[1] >= omh.LEAST]
        reached |= set(new)
        todo += new
    assert len(reached) > 250 and sum(got[i] == 0 for i in reached) >= 0.99 * len(reached) and all(got[i] != 0 for i in range(300) if i not in reached)
    assert all(got[1000 + i] == 1000 + i for i in range(100))


def test_texts_of_one_template_find_their_own_copies(spark):
    """Texts of a common template are 0.79 similar; the pairs among them, 0.82, share hardly a sketch of their own."""
    template, rows = text(42, 92), []
    for i in range(80):
        rows.append((i, " ".join([template, *(f"p{i // 2}w{j}" for j in range(2)), *(f"t{i}w{j}" for j in range(10))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in omh.classes(docs).collect()} == {i: i // 2 * 2 for i in range(80)}


def test_bounds_exclude_no_similar_pair():
    rng = np.random.default_rng(8)
    texts = []
    for n in (5, 60, 70, 125, 130, 300, 5000):
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        base[: n // 5] = base[0]
        for share in (0, 0.05, 0.1, 0.2, 0.5):
            other = np.where(rng.random(n) < share, rng.integers(1, 2**63, n).astype(np.uint64), base)
            texts += [other, other[: n - n // 10]]
    sizes, parts = np.array([len(t) for t in texts]), np.arange(len(texts))
    got = {(i, j) for i, at in omh.possible(sizes, parts, None, [omh.cell_counts(t) for t in texts]) for j in at.tolist()}
    similar = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if omh.similarity(texts[i], texts[j])[0] >= omh.LEAST}
    assert similar and similar <= got and len(got) < len(similar) * 2
    assert not {(i, j) for i, at in omh.possible(sizes, parts * 0, None, [omh.cell_counts(t) for t in texts]) for j in at}


def test_buckets_in_blocks_give_the_same_pairs(spark, monkeypatch):
    rows = [(1, p, 100, p % 7) for p in range(50)] + [(2, p, 100, p % 7) for p in range(40, 60)] + [(3, 1, 100, 1), (3, 8, 100, 1)]
    members = spark.createDataFrame([r[:3] for r in rows], "sig bigint, print bigint, kmers int")
    parts = spark.createDataFrame(sorted({(r[1], r[3]) for r in rows}), "node bigint, component bigint")
    distinct = spark.createDataFrame([(p, bytearray()) for p in range(60)], "print bigint, counts binary")
    want = {(a, b) for s in (range(50), range(40, 60)) for a in s for b in s if a < b and a % 7 != b % 7}
    for most in (2_048, 8):
        monkeypatch.setattr(omh, "CHUNK_TEXTS", most)
        assert {(r["a"], r["b"]) for r in omh._rest(members, distinct, parts).collect()} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert omh.classes(docs).count() == 0 and omh.deduplicate(docs).count() == 0


def test_banded_alignment_equals_the_whole_one():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(1, 6, rng.integers(20, 60)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), 2))
        b[rng.integers(0, len(b))] = 9
        most, got = omh.similarity(a, b, 0.5)
        m = lcs(a.tolist(), b.tolist())
        assert abs(got - m / (len(a) + len(b) - m)) < 1e-12 and got <= most + 1e-12


def test_sketches_tell_order():
    h = np.random.default_rng(1).integers(1, 2**63, 200).astype(np.uint64)
    assert (omh.sketches(h) == omh.sketches(h.copy())).all()
    assert (omh.sketches(h) == omh.sketches(h[::-1].copy())).mean() < 0.2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (5, 5), (None, 7), (200, 199)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
