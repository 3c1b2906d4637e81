from __future__ import annotations

from pyspark.sql import functions as F

from customsloom.operators import scoring

STATE = "invoice_id int, yes boolean, to string, gross double, net double, cartons int, pallets int, kind string, codes int, countries int, data boolean, vat boolean"


def settled(spark, issues, states):
    rows = spark.createDataFrame(states, STATE)
    state = scoring.resolutions(*(F.col(c) for c in rows.columns[1:]))
    out = scoring.with_resolution(spark.createDataFrame(issues, "invoice_id int, field string, message string"), rows.select("invoice_id", state.alias("resolved")))
    return [(r["code"], r["resolved_by"]) for r in out.orderBy("invoice_id", "field", "message").collect()]


def test_each_state_settles_its_own_issues(spark):
    by_code = {name: codes[0] for name, codes, _ in scoring.RESOLUTIONS}
    plain = [None, "DE", None, None, None, None, None, 0, 0, True, False]
    sets = {"origin_declared": (0, True), "outside_union": (1, "us"), "no_shipment_data": (8 + 1, False), "gross_known": (2, 1.0), "net_known": (3, 0.0), "packages_known": (4, 2), "codes_known": (7, 1), "countries_known": (8, 1), "vat_article": (10, True)}
    for name, (at, value) in sets.items():
        state = list(plain)
        state[at] = value
        codes = {c for _, cs, _ in scoring.RESOLUTIONS for c in cs}
        got = dict(settled(spark, [(1, c, None) for c in codes], [(1, *state)]))
        assert {c for c, by in got.items() if by == name} == {c for n, cs, _ in scoring.RESOLUTIONS if n == name for c in cs} and {by for by in got.values()} == {name, None}, by_code[name]


def test_messages_without_codes_and_documents_without_states(spark):
    issues = [(1, None, "HS codes not detected"), (1, None, "Please see ABC_1 today"), (1, " ", "Two  Words"), (1, None, None), (2, "MISSING_GROSS_WEIGHT", "x"), (None, "MISSING_VAT_ARTICLE", "x")]
    got = settled(spark, issues, [(1, None, None, None, None, None, None, None, 3, None, None, None)])
    assert sorted(got, key=str) == sorted([("hs codes not detected", "codes_known"), ("ABC_1", None), ("two words", None), (None, None), ("MISSING_GROSS_WEIGHT", None), ("MISSING_VAT_ARTICLE", None)], key=str)
    assert settled(spark, [], []) == []
