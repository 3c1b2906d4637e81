from __future__ import annotations

from customsloom.operators import ranking


def test_few_sets_of_terms_are_sent_to_all_tasks(spark, monkeypatch):
    terms = spark.createDataFrame([(q, t, w) for q in range(30) for t, w in (("red", 1.0), (f"t{q % 3}", 0.8))], "query_id int, term string, weight double")
    words = spark.createDataFrame([(f"{c:08d}", "cn8", t) for c in range(40) for t in ("red", f"t{c % 4}")], "cn8 string, layer string, term string")
    some = ranking.best(terms, words, None, 3)
    assert some._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    want = sorted(map(tuple, some.collect()))
    monkeypatch.setattr(ranking, "FEW_SETS", 1)
    assert sorted(map(tuple, ranking.best(terms, words, None, 3).collect())) == want and len(want) == 90
