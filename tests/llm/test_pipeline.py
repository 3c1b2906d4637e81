from __future__ import annotations

import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from customsloom.llm import queries
from tests.conftest import SF


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def test_every_operator_has_a_query():
    numbers = sorted(int(m[1]) for q in queries.QUERIES if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 4


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    bench = [" ".join(words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert out.columns == columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= ids and len(rows) >= 0.7 * len(ids)
        if name == "language":
            assert all(any(c.isalpha() for c in r["text"]) for r in rows)
        if name == "near_duplicates":
            assert len({tuple(words(r["text"])) for r in rows}) == len(rows)
        if name == "benchmark_passages":
            assert not any(f" {b} " in f" {' '.join(words(r['text']))} " for r in rows for b in bench if b)
        docs, ids = out, {r["doc_id"] for r in rows}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(columns) <= set(last.columns) and (last.rate > 0).all() and len(last) >= 0.7 * len(ids)


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, a table without rows or labels, and columns whose names the stages use themselves."""
    rows = [(1, None), (2, ""), (3, "12 !"), (None, "some words that stand alone here"), (4, "the same text in two rows of the table"), (4, "the same text in two rows of the table"), (5, "x " * 20_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 7, "k") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, p_high double, rate int, print string")
    for name, kind in (("benchmark", "item_id bigint, text string"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for given in (docs, docs.where("false"), docs.withColumn("lang", F.lit(None).cast("string"))):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
            assert set(docs.columns) <= set(now.columns) and len(now.columns) == len(set(now.columns))
        texts = sorted(r["text"][:8] for r in now.collect())
        assert texts == ([] if given.count() == 0 else ["some wor", "the same", "x x x x "])
