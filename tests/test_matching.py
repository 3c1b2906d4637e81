from __future__ import annotations

from customsloom.operators import matching
from customsloom.plans.matching import candidate_filters
from tests.conftest import SF


def test_texts_are_not_broadcast(spark):
    """A table of phrases without known size made Spark send the texts and their words to the driver and to all tasks."""
    texts = spark.range(1000).selectExpr("id", "concat('a small ring and a large bolt ', id) AS text")
    phrases = spark.createDataFrame([("ring",), ("large bolt",)], "phrase string")
    found = matching.containing(texts, phrases)
    sent = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "rightHint=(strategy=broadcast)" in x]
    assert len(sent) == 3 and "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.where("id < 2").collect()} == {(i, p) for i in (0, 1) for p in ("ring", "large bolt")}


def test_long_tables_of_phrases_find_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Small RING"), (2, "string of large bolts"), (3, None), (4, "")], "id int, text string")
    phrases = spark.createDataFrame([("ring",), ("large bolt",), ("",)], "phrase string")
    few = {tuple(r) for r in matching.containing(texts, phrases).collect()}
    monkeypatch.setattr(matching, "FEW_PHRASES", 1)
    assert few == {tuple(r) for r in matching.containing(texts, phrases).collect()} == {(1, "ring"), (2, "large bolt")}


def test_candidates_of_families_have_their_own_lists(spark):
    """Another query's lists of the same names once took their place."""
    got = {r["id"]: tuple(r)[1:] for r in candidate_filters(spark, SF).where("id IN (0, 9, 13)").collect()}
    assert got[0] == (True, True, False, False)  # ups in 8543; of the query's chapters; its priors are required; a figure that can't be
    assert got[9][0] is True  # ups, 8536, battery clamp
    assert got[13][2] is True and got[13][1] is False  # chapter 85 is excluded
