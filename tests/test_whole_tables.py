"""Queries over whole tables leave no row out."""

from __future__ import annotations

from customsloom.operators import pricing as operators
from customsloom.plans import pricing
from customsloom.queries import ORACLES, QUERIES
from tests.conftest import SF


def test_every_request_near_a_past_trip_gets_a_price(spark):
    """Against all pairs."""
    asked = [tuple(r) for r in pricing._trips(spark, SF).collect()]
    past = [tuple(r) for r in pricing._history(spark, SF).collect()]
    want = {}
    for i, d, w, p, m in asked:
        near = [(round(abs(h[1] - d) + abs(h[2] - w) / 100 + abs(h[3] - p) * 10 + abs(h[4] - m) * 10, 6), h[0]) for h in past if d * 0.5 <= h[1] <= d * 1.5]
        if near:
            want[i] = min(near)[1]
    for got in (QUERIES["freight_nearest"](spark, SF), operators.nearest_price(pricing._trips(spark, SF), pricing._history(spark, SF), pairs=0), operators.nearest_price(pricing._trips(spark, SF), pricing._history(spark, SF), pairs=30_000)):
        assert len(want) > 0.9 * len(asked) and {r["request_id"]: r["transport_id"] for r in got.collect()} == want
    assert {r["request_id"] for r in QUERIES["freight_price_tiers"](spark, SF).collect()} == set(want)
    assert all("% 10 = 0" not in ORACLES[q] for q in ("freight_nearest", "freight_price_tiers"))


def test_phrases_of_every_language_and_up_to_four_words(spark, tmp_path):
    rows = [(2 + 1455 * i, "mejor precio del mercado", lang) for i, lang in enumerate(["es", None, "es", "fr", None, "de"])]  # all of one code
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    phrases = {"mejor precio", "precio del", "del mercado", "mejor precio del", "precio del mercado", "mejor precio del mercado"}
    assert {r["phrase"]: r["weight"] for r in QUERIES["ngram_lexicon"](spark, str(tmp_path)).collect()} == dict.fromkeys(phrases, 6.0)
    assert {r["phrase"]: r["frequency"] for r in QUERIES["phrase_stats"](spark, str(tmp_path)).collect()} == dict.fromkeys(phrases, 6)
