"""Sinks and sources written and read again, and functions that few queries reach, by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from customsloom.functions import country, geo, numbers, tariff, text
from customsloom.operators import matching, origin, ranking, reconcile, rollup, scoring
from customsloom.plans.bindings import lines
from customsloom.sources import records
from tests.conftest import SF
from tests.test_functions import column


def ordered(df):
    return [r["line"] for r in df.orderBy("block", "ord").collect()]


def test_declaration_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "73181590", 1234.5, 'steel; "hex"'), (2, "39201021", 0.5, None)], "n int, code string, value double, description string")
    trace = spark.createDataFrame([(1, 4, "a")], "n int, position int, source string")
    got = ordered(records.declaration_lines({"Invoice": "7;8", "Exporter": "A"}, rows, trace, "n"))
    assert got == ['Invoice;"7;8"', "Exporter;A", "", "code;value;description", '73181590;1.234,50;"steel; ""hex"""', "39201021;0,50;", "", "position;source", "4;a"]
    records.write_lines(records.declaration_lines({"Invoice": "7"}, rows, trace, "n"), str(tmp_path / "d"))
    raw = next((tmp_path / "d").glob("part-*")).read_bytes()
    assert raw.startswith("\ufeffInvoice;7\r\n".encode()) and raw.count(b"\r\n") == 8
    records.write_declaration_csv(rows, str(tmp_path / "t"))
    assert b"1.234,50" in b"".join(f.read_bytes() for f in (tmp_path / "t").glob("part-*"))


def test_reports(spark):
    result = spark.createDataFrame([(3, 100.4, 60.0, 40.4, 59.8, 300.0, 200.0)], "route_id int, total_km double, domestic_km double, foreign_km double, domestic_percent double, domestic_cost double, foreign_cost double")
    got = ordered(records.allocation_lines(result, "Report", "Slovenia"))
    assert got[0] == '"Report"' and got[3:5] == ['"Total Route (km)";"100"', '"Slovenia Distance (km)";"60"'] and got[7] == '"Other Share";"40.2%"' and got[-1] == '"Other Amount (EUR)";"200.00"'
    defects = spark.createDataFrame([("b", 1, "x"), ("a", 4, "y, z")], "field string, failures int, ids string")
    got = ordered(records.review_lines(spark.createDataFrame([(2, None)], "cases int, rate double"), defects))
    assert got == ["# Review", "", "- **cases**: 2", "- **rate**: –", "", "| field | failures | ids |", "| --- | --- | --- |", "| a | 4 | y, z |", "| b | 1 | x |"]


def test_tables_are_kept_added_to_and_replaced(spark, tmp_path):
    at = str(tmp_path / "t")
    assert not records.available(spark, at)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, note string")
    records.append(rows, at)
    records.append(rows.limit(1), at)
    assert records.available(spark, at) and spark.read.parquet(at).count() == 3
    records.rebuild(rows, at, {"version": "2025"})
    assert spark.read.parquet(at).count() == 2 and spark.read.json(f"{at}.meta").first()["value"] == "2025"
    records.append_run(rows, str(tmp_path / "runs"), ["note"])
    got = spark.read.parquet(str(tmp_path / "runs")).orderBy("id").collect()
    assert json.loads(got[0]["payload"]) == {"note": "a"} and len({r["run_id"] for r in got}) == 2
    records.write_statistics(spark.createDataFrame([(7, 0.5)], "kept int, rate double"), str(tmp_path / "stats"))
    assert {r["key"]: json.loads(r["value"])["v"] for r in spark.read.json(str(tmp_path / "stats")).collect()} == {"kept": 7, "rate": 0.5}


def test_sources_by_mode_sheet_and_encoding(spark, tmp_path):
    a = spark.createDataFrame([("12345678",), ("1",)], "cn8 string")
    names = lambda df: sorted((r["source"], r["weight"]) for r in df.collect())
    assert names(records.active_records("seed", a, a, a)) == [("seed", 1.0)] == names(records.active_records("full", a, None, None))
    assert names(records.active_records("full", a, a, a)) == [("export", 0.6), ("import", 0.4)]
    with pytest.raises(ValueError, match="no source"):
        records.active_records("seed", None, a, a)
    assert [records.pick_sheet(["Notes", "AES 2024", "Import"], k) for k in ("export", "import")] == ["AES 2024", "Import"] and records.pick_sheet(["X"], "import") == "X"
    (tmp_path / "l.csv").write_bytes("Mesto;Cena\nKöln;2\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("Mesto;Cena\nKöln;2\n".encode())
    assert [records.read_csv(spark, str(tmp_path / f)).first()["mesto"] for f in ("l.csv", "u.csv")] == ["Köln", "Köln"]
    (tmp_path / "c.json").write_text(json.dumps({"families": [{"id": "a"}, {"id": "b"}]}))
    assert records.read_config(spark, str(tmp_path / "c.json"), "families").count() == 2 and records.read_config(spark, str(tmp_path / "none.json"), "families").count() == 0
    for case in ("x", "y"):
        (tmp_path / "g" / case).mkdir(parents=True)
        (tmp_path / "g" / case / "invoice-source.json").write_text(json.dumps({"n": case}))
    (tmp_path / "g" / "y" / "expected-results.json").write_text(json.dumps({"v": 1}))
    assert [(r["case_id"], r["source"]["n"], r["expected"]["v"]) for r in records.read_golden(spark, str(tmp_path / "g")).collect()] == [("y", "y", 1)]
    assert records.replicate(a, 3).count() == 6


def test_texts_of_documents(spark):
    rows = spark.createDataFrame([("ocr text", "ocr", "n"), ("other", "pdf text", " "), (None, "pdf", None)], "a string, b string, c string")
    assert [r[0] for r in rows.select(records.corpus(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["ocr text\nn", "other\npdf text", "pdf"]
    assert column(spark, ["a\n--- Page 1 of 2 ---\nb\nstran 2\n"], records.without_page_marks) == ["a\nb\n"]
    got = rows.select(*records.merged({"x": F.col("c"), "y": F.col("a")}, {"x": F.col("b")})).collect()
    assert [tuple(r) for r in got] == [("n", "ocr text"), ("pdf text", "other"), ("pdf", None)]


def test_small_functions(spark):
    assert column(spark, ["12,5", "7", "1.2345", "x", None], numbers.parse_weight) == [12.5, 7.0, None, None, None]
    assert column(spark, ["total 1.234,50 EUR", "none"], numbers.money_token) == [1234.5, None]
    assert column(spark, ["a 10,00\nVAT 99,00\non 01.02.2024 b 25,50"], numbers.largest_amount) == [25.5]
    assert column(spark, ["62 A > Trousers >  Of Denim ", "one", ""], lambda x: F.concat_ws("|", *text.split_hierarchy(x))) == ["62 a|trousers|of denim", "one||one", "||"]
    assert column(spark, ["für Kunden", "ćevap", "vijak za les", "steel"], text.language_hint) == ["de", "hr", "sl", "en"]
    assert len(set(column(spark, ["a  b", " A B ", "c"], text.description_hash))) == 2
    assert column(spark, ["syrups of ups"], lambda x: text.term_in(F.lit("ups"), x)) == [True] and column(spark, ["syrups"], lambda x: text.term_in(F.lit("ups"), x)) == [False]
    assert column(spark, ["73181590"], lambda x: F.concat_ws("|", tariff.chapter(x), tariff.heading(x), tariff.resolve_final(F.lit("??"), F.lit(None).cast("string"), x))) == ["73|7318|73181590"]
    assert column(spark, ["CIF"], lambda x: F.concat_ws("|", country.documents(F.lit("SEA"), F.lit("EXPORT"), x))) == ["Commercial invoice|Packing list|Bill of lading|Export declaration|Certificate of origin|Insurance certificate"]
    assert column(spark, [4.8], lambda x: geo.utilisation(geo.loading_meters(x)), "double") == [pytest.approx(2 / 13.6)]


def test_small_scores(spark):
    b = F.lit
    one = spark.range(1)
    assert one.select(scoring.confidence(b(10), b(5), b(True), b(False), b(True), b(False))).first()[0] == 60
    assert one.select(scoring.confidence(b(0), b(0), b(False), b(False), b(False), b(False))).first()[0] == 99
    got = one.select(*(scoring.export_status(b(s), b(e), b(g), b(c), b(False)) for s, e, g, c in ((95, 0, 3, 3), (95, 0, 3, 0), (85, 0, 3, 3), (95, 1, 3, 3), (70, 0, 3, 3)))).first()
    assert list(got) == ["Ready", "Ready With Review", "Ready With Review", "Needs Review", "Needs Review"]
    items = spark.createDataFrame([(1, "a", None), (1, " ", "62"), (2, "b", "62")], "invoice_id int, description string, hs_code string")
    assert sorted(tuple(r) for r in scoring.item_metrics(items).collect()) == [(1, 2, 1, 1), (2, 1, 1, 1)]
    got = one.select(*(origin.document_status(b(y), b(n), b(u)) for y, n, u in ((1, 1, 0), (2, 0, 0), (0, 1, 1), (0, 0, 3)))).first()
    assert list(got) == ["MIXED", "CONFIRMED", "NOT_PREFERENTIAL", "NOT_DECLARED"]
    assert one.select(origin.with_exclusions(b("YES"), b("S1"), ["S1"])).first()[0] == "NO"
    assert one.select(origin.authorisation_number(b("Customs authorization no. si/12/345"))).first()[0] == "SI/12/345"
    assert one.select(ranking.penalised(b(8.0), [(b(True), 0.5), (b(False), 0.1), (b(True), 0.25)]), ranking.tuned(b(1.0), [(b(True), "add", 3.0), (b(True), "times", 2.0)]), ranking.bonus(b(10.0), 0.2, b(0.5))).first()[:] == (1.0, 8.0, 1.0)
    key = reconcile.identity_key(b(1), b("a"), b(None).cast("string"), quantity=b(2.0), line_total=b(3.456), unit_price=b(1.0))
    assert one.select(key).first()[0] == "1|a||2.000|3.46|1.0000"


def test_sets_in_order(spark):
    a = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    got = spark.range(1).select(matching.ordered_union(a("b", "a"), F.lit(None).cast("array<string>"), a("a", None, "c", "b")), matching.difference(a("b", "a", "c"), a("a")), matching.intersection(a("b", "a"), F.lit(None).cast("array<string>"))).first()
    assert list(got) == [["b", "a", "c"], ["b", "c"], []]


def test_one_bucket_of_many(spark):
    own = lines(spark, SF)
    want = {r["hs_code"]: r["preferential_lines"] for r in rollup.preference_buckets(own).where("preferential_lines > 0").collect()}
    got = rollup.preference_bucket(own, "YES")
    assert got.count() == len(want)


def test_a_long_list_of_rules_stays_small(spark):
    steps = [(F.col("id") % (i + 2) == 0, "times", 1.0) for i in range(120)]
    assert spark.range(3).select(ranking.tuned(F.lit(2.0), steps)).distinct().first()[0] == 2.0
