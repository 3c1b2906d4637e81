from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from customsloom.llm import kneser_ney as kn
from customsloom.llm.common import HashIndex, blocks, mix, tokenise
from tests.conftest import SF
from tests.llm.helpers import text


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def brute(rows, held):
    train = [tokens(t) for i, t in rows if not held(i)]
    count = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    total, kinds, before = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (u, v), c in pairs.items():
        total[u] += c
        kinds[u][min(c, 3) - 1] += 1
        before[v] += 1
    of = lambda c: kn._discounts(np.array([list(c.values()).count(i) for i in (1, 2, 3, 4)]))
    d, e = of(pairs), of(before)
    n, v = sum(count.values()), len(count)
    b = collections.Counter(min(x, 3) for x in before.values())
    backoff = sum(e[i] * b[i + 1] for i in range(3)) / len(pairs) if pairs else 1.0
    cut = lambda c, d: max(c - (0, *d)[min(c, 3)], 0)

    def p(u, w):
        low = (cut(before[w], e) / len(pairs) if pairs else 0) + backoff / (v + 1)
        return cut(pairs[u, w], d) / total[u] + sum(x * y for x, y in zip(d, kinds[u], strict=True)) / total[u] * low if total[u] else low

    out = {}
    for i, t in rows:
        t = tokens(t)
        out[i] = (len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t], t, strict=False)))
    return out, p, count


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, p, count = brute(rows, held)
    for r in kn.score_documents(docs).collect():
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (*w[:3], held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(w[3]) and r["score"] == pytest.approx(w[4])
    assert sum(p("the", w) for w in count) + p("the", "not a word") == pytest.approx(1)


def test_many_shards_and_few_maps_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: r["score"] for r in kn.score(docs, kn.fit(docs)).collect()}
    monkeypatch.setattr(kn, "SHARD_BYTES", 10_000)
    model = kn.fit(docs)
    assert model.pair_shards > 20 and 5 < len(model.starts) - 1 < model.pair_shards
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in kn.score(docs, model).collect()} == want
    monkeypatch.setattr(kn, "MOST_MAPS", 3)
    texts = pa.array([r["text"] for r in docs.limit(5).collect()])
    for token, context, _, _ in kn._id_sequences(texts, model):
        few = kn.log_probabilities(model, token, context)[0]
        assert len(model.maps) <= 3
        monkeypatch.setattr(kn, "MOST_MAPS", 1_000)
        assert (kn.log_probabilities(model, token, context)[0] == few).all()
        monkeypatch.setattr(kn, "MOST_MAPS", 3)


def test_odd_rows(spark):
    long = text(1, 30_000)
    rows = [(1, None, 5), (2, "", 5), (3, "  \t\n", 5), (3, "a b", 6), (None, "A  b", 7), (4, long, 8), (5, "Éa é\x00b", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = kn.score_documents(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_tokens"]): r for r in got}
    assert by[1, 1]["n_tokens"] == 1 and by[3, 1] and by[3, 3] and by[None, 3]["held_out"] is False and by[4, 30_001]


def test_empty_table(spark):
    assert kn.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    r = kn.score(docs, kn.fit(docs.where("false"))).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_tokens_across_texts_stay_apart():
    t = pa.array(["ab", "cd", None, " ab "])
    (_, data, offsets), = blocks(t)
    k = tokenise(data, offsets)
    assert np.diff(k.doc_start).tolist() == [1, 1, 0, 1] and k.hashes[0] == k.hashes[2] != k.hashes[1]


def test_hash_index_and_mixer():
    keys = np.unique(mix(np.arange(1, 5001, dtype=np.uint64)))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(mix(np.arange(9001, 9101, dtype=np.uint64))) == -1).all()
    assert (kn._unmix(mix(keys)) == keys).all()
