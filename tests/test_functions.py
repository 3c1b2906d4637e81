from __future__ import annotations

import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from customsloom.functions import country, dates, geo, numbers, tariff, text
from customsloom.operators import origin, scoring


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_locale_numbers(spark):
    cases = {"1.234,50": 1234.5, "21,790.30": 21790.3, "1123.50": 1123.5, "21.790": 21790.0, "1.234.567": 1234567.0, "12,5": 12.5, "1,234,567": 1234567.0, "EUR 5 593,70": 5593.7, "-3,5": -3.5, "": 0.0, "abc": 0.0, None: 0.0}
    assert column(spark, list(cases), numbers.parse_locale_number) == list(cases.values())


def test_the_strict_reader_takes_dots_for_thousands(spark):
    assert column(spark, ["1123.50", "1.123,50"], numbers.parse_eu_strict) == [112350.0, 1123.5]


def test_quantities(spark):
    cases = {"1400": 1400.0, "1 400": 1400.0, "1.400": 1400.0, "2,000 pcs": 2000.0, "12 kg": 12.0, "-4": 0.0, None: 0.0}
    assert column(spark, list(cases), numbers.parse_quantity) == list(cases.values())


def test_mass_mends_only_the_comma(spark):
    assert column(spark, ["1,5", "1.234,5", "", "nan", "7"], numbers.parse_mass) == [1.5, None, None, None, 7.0]


def test_quantity_repair(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4000.0), (5.0, 2.0, 10.0), (3.0, None, 9.0)], "q double, p double, t double")
    assert [r[0] for r in df.select(numbers.repair_quantity(F.col("q"), F.col("p"), F.col("t"))).collect()] == [2000.0, 5.0, 3.0]


@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_numbers_written_in_any_manner_are_read_again(spark, cents):
    us = [f"{c // 100:,}.{c % 100:02d}" for c in cents]
    eu = [x.translate(str.maketrans(",.", ".,")) for x in us]
    want = [float(f"{c // 100}.{c % 100:02d}") for c in cents]
    assert column(spark, us, numbers.parse_locale_number) == want
    assert column(spark, eu, numbers.parse_locale_number) == want


def test_rounding(spark):
    assert column(spark, [2.675, -2.5, 0.125], numbers.round_money, "double") == [2.68, -2.5, 0.13]
    assert column(spark, [2.5, 3.5, -0.5], numbers.round_even, "double") == [2.0, 4.0, 0.0]
    assert column(spark, [12.5, 17.5, 13.0], numbers.round_to_5, "double") == [10.0, 20.0, 15.0]
    assert column(spark, [1234.5], numbers.format_declaration, "double") == ["1.234,50"]


def test_codes(spark):
    assert column(spark, ["7318159090", "39201021", "8302.42.00 90", "123"], tariff.cn8) == ["73181590", "39201021", "83024200", None]
    assert column(spark, ["6203.42-31", "62O34231", "HS-620342", "", "--"], lambda x: tariff.normalise(x)[0]) == ["62034231", "62034231", None, None, None]
    assert column(spark, ["6203", "62O34231", "??"], lambda x: tariff.normalise(x)[1]) == [True, False, False]


def test_worst_status_in_both_modes(spark):
    df = spark.createDataFrame([(["VALID", "INVALID_FORMAT"],), ([],)], "s array<string>")
    got = df.select(tariff.worst_status(F.col("s")).alias("r"), tariff.worst_status(F.col("s"), "intended").alias("i")).collect()
    assert [tuple(r) for r in got] == [("VALID", "INVALID_FORMAT"), ("MISSING", "MISSING")]


def test_longest_prefix(spark):
    known = spark.createDataFrame([("62034231",), ("6109100010",)], "cn_digits string")
    rows = spark.createDataFrame([("6203423199",), ("6109100010",), ("620342",), ("99999999",)], "code string")
    got = {r["code"]: r["match_level"] for r in tariff.longest_prefix(rows, known, "code").collect()}
    assert got == {"6203423199": "cn8", "6109100010": "taric10", "620342": "hs6", "99999999": "none"}


def test_tokens_and_phrases(spark):
    assert column(spark, ["Moške hlače, COTTON 42"], text.search_tokens) == [["cotton"]]
    df = spark.createDataFrame([(["steel", "hex", "bolt"],)], "w array<string>")
    assert df.select(text.ngrams(F.col("w"))).first()[0] == ["steel hex", "hex bolt", "steel hex bolt"]
    assert column(spark, ["3 and 8, 10-12"], text.positions) == [[3, 8, 10, 11, 12]]
    assert column(spark, ["12 KOS vijak; M8 ,"], text.strip_quantity) == ["KOS vijak M8"]


def test_rewriting_sees_earlier_rewrites(spark):
    rules = [("vijak z matico", "bolt set"), ("set", "kit"), ("vijak", "bolt")]
    assert column(spark, ["vijak z matico in vijak"], lambda x: text.rewrite(x, rules)) == ["bolt kit in bolt"]


def test_kinds_of_lines(spark):
    assert column(spark, ["Freight to Vienna", "Wooden box", "Hex bolt", None], text.line_type) == ["SERVICE", "PACKAGING", "GOODS", "GOODS"]
    assert column(spark, ["Invoice No 12", "abc", "steel bolt"], text.is_metadata) == [True, True, False]
    assert column(spark, ["IVECO truck", "spare part for truck"], text.is_complete_vehicle) == [True, False]


def test_dice(spark):
    df = spark.createDataFrame([("night", "nacht"), ("bolt m8", "bolt m8"), ("bolt", "bolt m8"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(text.dice(F.col("a"), F.col("b"))).collect()] == [0.25, 1.0, 0.98, 1.0]


def test_dates(spark):
    d = datetime.date
    assert column(spark, ["2024-02-29", "31/12/2023", "12/31/2023", "3.4.2024", "2024-02-30", "x"], dates.parse_invoice_date) == [d(2024, 2, 29), d(2023, 12, 31), d(2023, 12, 31), d(2024, 4, 3), None, None]


def test_countries(spark):
    assert column(spark, ["si", "Street 1\nVienna, Austria", "Foo (HR)", "nowhere at all"], country.resolve) == ["SI", "AT", "HR", None]


def test_distances_and_polygon(spark):
    df = spark.createDataFrame([(46.05, 14.5), (48.2, 16.4)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.in_polygon(F.col("lat"), F.col("lon"))).collect()] == [True, False]
    km = df.select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0), geo.FREIGHT_RADIUS)).first()[0]
    assert km == pytest.approx(6371.0 * 3.141592653589793 / 2)


def test_origin_rules(spark):
    corpus = "EUR.1 covers all goods except positions 2 and 4-5."
    df = spark.createDataFrame([(i, corpus) for i in range(1, 6)], "p int, t string")
    # "all goods except" says that the EUR.1 covers the rest
    assert [r[0] for r in df.orderBy("p").select(origin.line_preference(F.col("p"), F.col("t"))).collect()] == ["YES", "NO", "YES", "NO", "NO"]
    df = df.withColumn("t", F.lit("EUR.1 enclosed except positions 2 and 4-5."))
    assert [r[0] for r in df.orderBy("p").select(origin.line_preference(F.col("p"), F.col("t"))).collect()] == ["UNKNOWN", "NO", "UNKNOWN", "NO", "NO"]
    assert column(spark, ["DE", "GB", "CA", "CH", "US", None], origin.scheme) == ["NO_PREFERENCE", "UK", "REX", "PEM", "NO_PREFERENCE", "NO_PREFERENCE"]


def test_findings(spark):
    df = spark.createDataFrame([(12.0, 10.0, True, 12.0), (9.0, 10.0, True, 9.0)], "n double, g double, d boolean, l double")
    got = [r[0] for r in df.select(scoring.weight_findings(F.col("n"), F.col("g"), F.col("d"), F.col("l"))).collect()]
    assert got == [["NET_EXCEEDS_GROSS", "UNIT_WEIGHT_MISUSE"], []]


def test_ranking_keeps_the_best_of_all_pairs(spark):
    """Against every pair of query and code, with hints of chapters and headings, and words that must come together."""
    import itertools
    import random

    from customsloom.operators import ranking

    rng = random.Random(3)
    vocabulary = ["ball", "bearing", "steel", "ring", "pellet", "rifle", "shot", "bolt"]
    words = {f"{rng.choice(['84', '93', '73'])}{rng.choice(['82', '06'])}{i:04d}": {(w, rng.choice(["cn8", "heading", "chapter"])) for w in rng.sample(vocabulary, 3)} for i in range(60)}
    queries = {q: [(w, rng.choice([0.1, 1.0, 2.8])) for w in rng.sample(vocabulary, rng.randint(1, 4))] for q in range(12)}
    queries[90], queries[91] = [("ball", 1.0), ("bearing", 1.0)], [("pellet", 1.0), ("rifle", 2.8)]
    hints = {q: rng.sample(["84", "93", "8482", "9306"], rng.randint(0, 2)) for q in queries}
    factor = {"cn8": 3.0, "heading": 2.2, "chapter": 1.4}
    want = {}
    for q, (code, own) in itertools.product(queries, words.items()):
        asked, held = {w for w, _ in queries[q]}, {w for w, _ in own}
        if not asked & held:
            continue
        score = sum(weight * max(factor[layer] for w, layer in own if w == term) for term, weight in queries[q] if term in held)
        for wanted in {w for when, w in ranking.CO_TERMS if set(when) <= asked}:
            score *= 1.0 if set(wanted) & held else 0.15
        score = round(score, 6) + 4.0 * (code[:2] in hints[q]) + 5.0 * (code[:4] in hints[q])
        if score >= 2.0:
            want.setdefault(q, []).append((-round(score, 6), code))
    terms = spark.createDataFrame([(q, t, w) for q, ts in queries.items() for t, w in ts], "query_id int, term string, weight double")
    known = spark.createDataFrame([(c, layer, w) for c, own in words.items() for w, layer in own], "cn8 string, layer string, term string")
    asked = spark.createDataFrame([(q, h) for q, hs in hints.items() for h in hs], "query_id int, hint string")
    got = {}
    for r in ranking.best(terms, known, asked, 4).collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 6), r["cn8"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x)[:4] for q, x in want.items()}


def test_any_of_finds_what_its_patterns_find():
    import re

    from customsloom.functions import text

    own = [*text.SERVICE, *text.PACKAGING, *text.METADATA, *text.VEHICLE]
    assert text.any_of(own).count(r"|\b(?:") == 1
    says = "transport|a transport|freight|airfreight|free freight|courier|2 pallets|pal|opal|palate|boxes|box|1 box|wooden  case|stroški izvoza|vin 1|kw|12345678901234567|x 12345678901234567|total|subtotal|cm3|lkw|kompletno vozilo|3 actros|Actros|steel bolts|".split("|")
    odd = [r"\bred|blue", r"\b[|(]x", r"\b\(a|b\)", r"\bone(?:s|d)?\b", "two"]
    for patterns, texts in ((own, says), (odd, ["red", "xblue", "blue", "a|x", "(a", "b)", "bones", "ones", "twofold", ""]), ([], ["a"]), ([r"\ba"], ["ba", "a"])):
        plain = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
        assert [bool(re.search(text.any_of(patterns), t)) for t in texts] == [bool(re.search(plain, t)) for t in texts]
