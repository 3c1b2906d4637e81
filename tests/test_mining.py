from __future__ import annotations

import re
from collections import defaultdict

import pytest
from customsloom.functions.text import fold, ngrams, search_tokens
from customsloom.operators import mining
from customsloom.queries import QUERIES
from pyspark.sql import functions as F
from tests.conftest import SF


def _rows(spark):
    rows = [(i, f"c{i % 3}", 0.4 + 0.3 * (i % 2), "seed" if i % 4 else "x", f"red steel ring {i % 5} a b of {'blue' if i % 2 else 'hot'} gear no{i} part{i * 7}") for i in range(60)] + [(60, "c0", 9.0, "x", "one word"), (61, "c1", 1.0, "x", None), (62, None, 5.0, "x", "red steel ring")]
    return spark.createDataFrame(rows, "id int, cn8 string, weight double, source string, description string")


def test_rare_phrases_are_dropped_before_they_are_shuffled_and_nothing_else(spark, monkeypatch):
    rows = _rows(spark)
    all_ = rows.select("cn8", "weight", F.explode(ngrams(search_tokens(fold(F.col("description")), 2), 2, 4)).alias("phrase"))
    want = {(r[0], r[1], round(r[2], 2)) for r in all_.groupBy("phrase", "cn8").agg(F.sum("weight")).collect() if round(r[2], 2) >= 5}
    for slots in (20, 0):  # one word of 64 bits lets much through, and changes nothing
        monkeypatch.setattr(mining, "SLOTS", slots)
        assert {tuple(r) for r in mining.phrase_lexicon(rows).select("phrase", "cn8", "weight").collect()} == want
    monkeypatch.setattr(mining, "SLOTS", 20)
    words = rows.select("cn8", "weight", search_tokens(fold(F.col("description")), 2).alias("words"))
    assert len(want) > 20 and mining._phrases(words, (2, 4), F.col("weight"), 4.99).count() < 0.7 * all_.count()


def test_stats_from_a_number_of_texts_on(spark):
    rows = _rows(spark)
    every = {tuple(r) for r in mining.phrase_stats(rows, sizes=(2, 4)).collect()}
    assert {tuple(r) for r in mining.phrase_stats(rows, sizes=(2, 4), least=3).collect()} == {r for r in every if r[2] >= 3} != every


def _by_hand(rows, sizes):
    """Texts of each (phrase, cn8), as they come."""
    found = defaultdict(list)
    for r in rows.collect():
        words = [w for w in re.findall("[a-z0-9]+", (r["description"] or "").lower()) if len(w) >= 2]
        for p in {" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)}:
            if len(p) >= 6:
                found[p, r["cn8"]].append(r)
    return found


def _expected_stats(rows, sizes, least):
    seeds = lambda rs, mine: sum(r["source"] is not None and (r["source"] == "seed") == mine for r in rs)
    return {(p, c, len(rs), len({r["description"] for r in rs}), seeds(rs, True), seeds(rs, False)) for (p, c), rs in _by_hand(rows, sizes).items() if len(rs) >= least}


def _odd(spark):
    more = [(100 + i, ["c0", None][i % 2], [1.0, None][i % 3 == 0], [None, "seed", "x"][i % 3], text) for i, text in enumerate(["ab cd ef ab cd ef", "AB cd ef ab cd ef", "x", "", "red steel\nring of red", "red steel ring", "red steel ring", "red steel ring"] * 2)]
    rows = _rows(spark)
    return rows.unionByName(spark.createDataFrame(more, rows.schema)).repartition(3)


@pytest.mark.parametrize("sizes", [(1, 2), (2, 4)])
def test_codes_of_any_length_by_hand(spark, monkeypatch, sizes):
    """Of one task at a time, a few phrases at a time, and dealt out."""
    rows = _odd(spark)
    for text, chunk, slots in ((1 << 25, 100, 3), (300, 100, 20)):
        monkeypatch.setattr(mining, "MOST_TEXT", text)
        monkeypatch.setattr(mining, "CHUNK", chunk)
        monkeypatch.setattr(mining, "SLOTS", slots)
        for least in (1, 3):
            got = [tuple(r) for r in mining.phrase_stats(rows, sizes=sizes, least=least).collect()]
            assert len(got) == len(set(got)) and set(got) == _expected_stats(rows, sizes, least)
        want = {(p, c): sum(r["weight"] or 0 for r in rs) for (p, c), rs in _by_hand(rows, sizes).items()}
        assert {(r["phrase"], r["cn8"]): r["weight"] for r in mining.phrase_lexicon(rows, sizes=sizes).collect()} == {k: pytest.approx(w) for k, w in want.items() if round(w, 2) >= 5}


@pytest.mark.parametrize("name", ["phrase_stats", "phrase_stats_all", "ngram_lexicon", "ngram_lexicon_all"])
def test_texts_are_shuffled_once_and_phrases_never(spark, name):
    """The beginnings of all phrases were shuffled, and the phrases that a table of fixed size let through, which is full on large tables."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(cn8" in plan and "Aggregate" not in plan
