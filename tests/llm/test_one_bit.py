from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from customsloom.llm import one_bit as ob
from tests.conftest import SF


def brute(rows, asks, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in ok]
    ok = [(i, v) for i, v in ok if len(v) == max(set(sizes), key=lambda s: (sizes.count(s), s))]
    out = {}
    for q in {i for i, _ in ok if asks(i)}:
        v = min((tuple(v) for i, v in ok if i == q))
        near = sorted((-float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), i) for i, x in ok if i != q)
        out[q] = near[:k]
    return out


def recall(got, want):
    hits = total = 0
    for q, near in want.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, len(near) + 1))
        hits += sum(abs(s + c) < 1e-9 for (_, _, s), (c, _) in zip(own, near, strict=True))
        total += len(near)
    return hits / max(1, total)


def test_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = ob.every_fiftieth(vectors).collect()
    assert recall(got, brute(rows, lambda i: i % 50 == 0)) >= 0.9
    assert {r["query_id"] for r in got} == {i for i, _ in rows if i % 50 == 0}


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(8)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [None] * 16), (2200, [1.0, 2.0]), (None, rows[5][1]), (50, rows[50][1]), (2250, [float("inf")] * 16)]
    vectors = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id bigint, embedding array<float>, score double")
    got = ob.every_fiftieth(vectors).collect()
    want = brute(rows, lambda i: i % 50 == 0)
    assert {r["query_id"] for r in got} == set(want) and recall(got, want) >= 0.97
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [1000, 1001, 1002, 1003, 1004]


def test_few_and_no_rows(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ob.every_fiftieth(vectors).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ob.every_fiftieth(vectors.where("vec_id = 0")).count() == 0 and ob.every_fiftieth(vectors.where("false")).count() == 0


def test_blocks_of_queries_give_the_same(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows, dims = ob.usable(vectors, "vec_id", "embedding")
    frame = ob.fit(rows, dims)
    codes = ob.index(rows, frame)
    asks = codes.where(F.col("id") % 10 == 0).select("id", "v")
    one, many = ob.search(codes, asks, frame).collect(), ob.search(codes, asks, frame, block=2).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_estimates_stay_within_their_error():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    q, r = np.linalg.qr(rng.standard_normal((64, 64)))
    frame = ob.Frame(x.mean(0) * 0, q * np.sign(np.diag(r)))
    bits, scalars = frame.encode(x)
    signs = np.unpackbits(bits, axis=1, count=64) * 2.0 - 1
    ask = rng.standard_normal((50, 64))
    ask /= np.linalg.norm(ask, axis=1, keepdims=True)
    f = scalars[:, 2].astype(float)
    estimate = ask @ frame.rotation.T @ signs.T / 8 / f
    true = ask @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert (np.abs(estimate - true) <= 3 * np.sqrt((1 - f * f) / f / f / 63)).mean() > 0.99
