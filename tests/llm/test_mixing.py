from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from customsloom.llm import mixing
from tests.llm.helpers import text


def table(spark, n=240):
    rows = []
    for i in range(n):
        kind = ("high", "low", "toxic")[0 if i % 4 < 2 else i % 4 - 1]
        words = text(i, 60)
        words = words.upper() + "!!" if kind == "low" else words + (" vile nasty rotten" if kind == "toxic" else "")
        rows.append((i, words, kind))
    return spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), {i: k for i, _, k in rows}


def labelled(spark, kinds, share=2):
    return spark.createDataFrame([(i, int(k != "low"), int(k == "toxic")) for i, k in kinds.items() if i % (share + 1) == 0], "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_targets(spark):
    docs, kinds = table(spark)
    got = mixing.rates(docs, labelled(spark, kinds), {"high": 0.6, "low": 0.4, "toxic": 0.0}).toPandas()
    names = ["p_high", "p_low", "p_toxic"]
    right = [names[int(np.argmax(r))][2:] == kinds[i] for i, r in zip(got.doc_id, got[names].to_numpy(), strict=True)]
    assert np.mean(right) > 0.95 and np.allclose(got[names].sum(axis=1), 1)
    share = (got[names].to_numpy() * (got.n_tokens * got.rate).to_numpy()[:, None]).sum(0) / got.n_tokens.sum()
    assert np.abs(share - [0.6, 0.4, 0.0]).max() < 0.03
    assert got.rate[[kinds[i] == "toxic" for i in got.doc_id]].max() < 0.1 and got.rate.min() >= 0


def test_steps_reach_the_least_squares(spark):
    """Against a long run of plain projected gradient over the whole matrix."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens bigint, p array<double>")
    want = np.array([0.7, 0.2, 0.1])
    rates = mixing.replay(p, mixing.solve(members, want), mixing.RIDGE)[0]
    share = (n @ p) / n.sum()
    r = np.ones(400)
    for _ in range(20_000):
        r = np.maximum(0, r - (p @ (((r * n) @ p / n.sum() - want) / share) + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE))
    assert np.abs(((rates - r) * n) @ p / n.sum()).max() < 1e-3


def test_unwanted_documents_go_and_no_others(spark):
    docs, kinds = table(spark)
    got = mixing.mix(docs, labelled(spark, kinds), mixing.label_domain(), mixing.TARGETS)
    rows = got.collect()
    assert {r["doc_id"] for r in rows if r["rate"] == 0} == {i for i, k in kinds.items() if k == "toxic"}
    weight = {r["domain"]: r["weight"] for r in mixing.reached(got).collect()}
    total = sum(r["n_tokens"] for r in rows)
    assert all(abs(w - sum(r["n_tokens"] * r["rate"] * r["posteriors"][d] for r in rows) / total) < 1e-9 for d, w in weight.items())
    assert weight["toxic"] < 0.005


def test_removal_depends_on_a_documents_own_posteriors(spark):
    """Whatever toxic chance clean documents have, sure toxic ones go, and a clean one of toxic chance 0.3 stays."""
    w = np.array([0.9, 0.1, 0.0])
    for leak in (0.0, 0.001, 0.02):
        p = np.array([[0.99 - leak, 0.01, leak]] * 55 + [[0.01, 0.99 - leak, leak]] * 40 + [[0.005, 0.005, 0.99]] * 5 + [[0.0, 0.7, 0.3]])
        members = spark.createDataFrame([(100, x.tolist()) for x in p], "n_tokens bigint, p array<double>")
        gradients = mixing.solve(members, w, floor=mixing.LEAST_RATE)
        rate = mixing.replay(p, gradients, mixing.RIDGE, mixing.unwanted(p, w), mixing.LEAST_RATE)[0]
        assert (rate[95:100] == 0).all() and (rate[:95] > 0).all() and rate[100] > 0


def test_odd_rows(spark):
    docs, kinds = table(spark, 60)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (None, "vile nasty rotten"), (3, text(3, 60)), (1002, text(9, 20_000))], "doc_id bigint, text string")
    all_docs = docs.unionAll(odd).withColumns({"rate": F.lit("x"), "n_tokens": F.lit("y")})
    marks = labelled(spark, kinds).unionAll(spark.createDataFrame([(None, 1, 0), (5, None, None), (9999, 1, 1), (3, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int"))
    out = mixing.mix(all_docs, marks, mixing.label_domain(), mixing.TARGETS)
    assert out.columns == ["doc_id", "text", "n_tokens", "posteriors", "rate"]
    got = out.collect()
    assert len(got) == 65 and all(r["rate"] >= 0 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["n_tokens"] == by[1001]["n_tokens"] == 0 and by[1000]["rate"] == by[1001]["rate"] and by[1002]["n_tokens"] == 20_000


def test_without_labels_and_rows(spark):
    docs, kinds = table(spark, 12)
    none = labelled(spark, kinds).where("false")
    assert {r["rate"] for r in mixing.rates(docs, none).collect()} == {1.0}
    one = mixing.rates(docs, labelled(spark, {0: "high", 3: "high"})).collect()
    assert all(abs(r["rate"] - 1) < 1e-6 for r in one)
    assert mixing.rates(docs.where("false"), labelled(spark, kinds)).count() == 0


def test_sample_is_bounded_in_rows_and_bytes(spark):
    """Ids that repeat, with other texts each time, and texts longer than the bound."""
    docs = spark.range(4_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionAll(spark.range(50).select((F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("long text "), 3_000).alias("text"))).unionAll(spark.range(50).select((F.col("id") + 200).alias("doc_id"), F.lit("same").alias("text")))
    docs = docs.unionAll(docs.where("doc_id >= 200"))
    labels = spark.createDataFrame([(i, "a") for i in (5, 5, 5)] + [(100 + i, "b") for i in range(50)] + [(200 + i, "c") for i in range(50)], "id bigint, domain string")
    got = mixing._sample(docs, labels, {"a": 3, "b": 50, "c": 50}, "doc_id", "text", 50, 20_000).groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()
    found = {r["domain"]: (r["n"], r["size"]) for r in got}
    assert set(found) == {"a", "c"} and found["c"] == (50, 200)  # a repeated row is one; no text of b is within the bound
    assert 50 <= found["a"][0] <= 100 and found["a"][1] <= 20_000
