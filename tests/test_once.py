"""Values that an expression uses often are worked out once a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from customsloom.functions.numbers import once, parse_locale_number
from customsloom.operators import documents, tuning


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_once(spark):
    df = spark.createDataFrame([(3,), (None,)], "x int")
    assert [r[0] for r in df.select(once(F.col("x"), lambda y: F.coalesce(y * y, F.lit(0)))).collect()] == [9, 0]


def test_numbers_and_totals_read_their_text_once(spark):
    df = spark.createDataFrame([("1.000,00 EUR",), (None,)], "text string")
    plan = planned(df.select(parse_locale_number(F.col("text")).alias("x")))
    assert plan.count("regexp_replace(coalesce(text") == 1
    plan = planned(df.select(documents.tabular_total(F.col("text")).alias("x")))
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_extract(text") == 2


def test_what_is_told_of_a_candidate_is_put_together_once(spark):
    df = spark.createDataFrame([(1.0, ["a"], "9025", "x")], "score double, f array<string>, h string, d string")
    score = tuning.industrial(F.col("score"), F.lit(True), F.col("h") == "1", F.col("f"), F.col("h"), F.array("h"), F.array("d"), F.col("f"), F.col("f"), F.col("d"))
    assert planned(df.select(score.alias("x"))).count("THEN sensor:hinted") == 1
