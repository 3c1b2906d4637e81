from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from customsloom.llm import blockwise, relative_lz
from customsloom.llm.common import tokenise
from tests.llm.helpers import text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """Every window of every text."""
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(ws[i : i + window]) for ws in words for i in range(len(ws) - window + 1))
    out = []
    for (doc, _), ws in zip(docs, words, strict=True):
        gone = {j for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)))
    return sorted(out, key=str)


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_least_of_runs():
    values = np.array([5, 3, 3, 9, 1, 1, 7, 2, 2, 2, 8])
    for width in range(1, 8):
        want = [max(range(i, i + width), key=lambda j: (-values[j], j)) for i in range(len(values) - width + 1)]
        assert relative_lz._least(values, width).tolist() == want


def test_equal_windows_have_equal_anchors():
    a, b = text(1, 300).split(), text(2, 100).split()
    docs = [" ".join(a[50:120]), " ".join(b + a[40:130] + b[:7]), " ".join(a)]
    raw = [d.encode() for d in docs]
    t = tokenise(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lower=False)
    by_window = {}
    for doc, start, n, anchor, _ in zip(*relative_lz.phrases(t, 35), strict=True):
        for i in range(start, start + n):
            by_window.setdefault(tuple(docs[doc].split()[i : i + 35]), set()).add(anchor)
    assert all(len(v) == 1 for v in by_window.values())
    assert len(by_window) == len({tuple(d.split()[i : i + 35]) for d in docs for i in range(len(d.split()) - 34)})


@pytest.mark.parametrize(("window", "seed"), [(35, 1), (35, 2), (9, 3), (3, 4)])
def test_same_as_all_windows(spark, monkeypatch, window, seed):
    monkeypatch.setattr(blockwise, "BLOCK_TEXT", 20_000)
    rng = random.Random(seed)
    passages = [text(1000 + i, rng.randint(20, 90)).split() for i in range(12)]
    docs = []
    for i in range(150):
        ws = []
        for _ in range(rng.randint(0, 5)):
            p = passages[min(rng.randrange(12), rng.randrange(12))]
            lo = rng.choice([0, 0, rng.randrange(len(p))])
            ws += text(rng.randrange(10**6), rng.randint(0, 50)).split() + p[lo : lo + rng.choice([99, rng.randint(1, 60)])]
        docs.append((i, " ".join(ws)))
    docs += [(200 + i, docs[i % 7][1]) for i in range(20)]
    p = relative_lz.parse(frame(spark, docs), window)
    assert got(relative_lz.stripped(p)) == brute(docs, window)
    spanned = Counter()
    for r in relative_lz.spans(p).collect():
        spanned[r["id"]] += r["end"] - r["start"]
    assert {i: n for i, _, n, _ in brute(docs, window) if n} == dict(spanned)


def test_odd_rows(spark):
    same = text(9, 40)
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "w " * 34), (5, "w " * 35), (6, "w " * 36), (7, "Aa " * 30_000), (None, same), (8, same.upper()), (9, f"\n{same.replace(' ', '  ')}\t"), (9, text(10, 60)), (9, text(10, 60)), (10, "x" * 400_000), (11, "né " * 20 + same)]
    df = spark.createDataFrame([(*r, i, 0) for i, r in enumerate(docs)], "doc_id bigint, text string, uid int, START int")
    want = [(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute(docs, 35)]
    out = relative_lz.digests(df)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got(out) == sorted(want, key=str)
    assert relative_lz.digests(df.limit(0)).count() == 0
