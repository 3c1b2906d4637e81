from __future__ import annotations

from pyspark.sql import functions as F

from customsloom.operators import identity, scoring


def test_styles_colours_and_sizes(spark):
    rows = [
        ("1ABCDEF12345 Navy trousers size: XL", None, "1ABCDEF12345", "NAVY", "XL"), ("trousers 2xyz00000001 BLK 12,5", "code", "2XYZ00000001", "BLK", ""), ("shirt HS Code - 6203 42 origin - China", " 1qwertyuiop ", "1QWERTYUIOP", "", ""),
        (None, None, "", "", ""), ("3ABCDEF12345 sz 42", "", "", "ABCDE"[:0], "42"), ("1ABCDEFGHIJK 1abcdefghijk red", None, "1ABCDEFGHIJK", "RED", ""),
    ]
    df = spark.createDataFrame([(i, d, c) for i, (d, c, *_) in enumerate(rows)], "i int, description string, item_code string")
    got = {r["i"]: (r["style"], r["colour"], r["size"]) for r in identity.with_identity(df).collect()}
    assert got == {i: tuple(r[2:]) for i, r in enumerate(rows)}


def test_styles_with_several_codes_or_countries(spark):
    df = spark.createDataFrame([(1, "S", "6203", "SI"), (1, "S", "6204", "SI"), (1, "T", "1", "SI"), (1, "T", "1", "DE"), (1, "", "2", "x"), (1, "", "3", "y"), (2, "S", "9", None)], "invoice_id int, style string, hs_code string, country string")
    assert sorted((r["style"], r["codes"], r["countries"], r["kind"]) for r in identity.conflicts(df).collect()) == [("S", ["6203", "6204"], ["SI"], "HS_STYLE_MISMATCH"), ("T", ["1"], ["DE", "SI"], "COO_STYLE_MISMATCH")]


def test_scores_are_capped_and_codes_cost_once(spark):
    documents = spark.createDataFrame([(1, 100, "CUSTOMS_READY"), (2, 100, "CUSTOMS_REVIEW"), (3, 100, "CUSTOMS_BLOCKED"), (4, 70, "CUSTOMS_READY"), (5, 10, None)], "invoice_id int, base int, status string")
    issues = [(1, "MISSING_VAT_ARTICLE", "error", False), (1, "OTHER", "error", None), (4, "EU_DESTINATION", "warning", False), (4, "EU_DESTINATION", "error", False), (5, "INVOICE_DATE_IN_FUTURE", "error", True), (9, None, None, None)]
    out = scoring.customs_score(documents, spark.createDataFrame(issues, "invoice_id int, code string, kind string, critical boolean"))
    assert {r["invoice_id"]: (r["customs_score"], r["label"]) for r in out.collect()} == {
        1: (95, "Ready for export declaration"), 2: (85, "Mostly ready — review gaps"), 3: (45, "Not ready for filing"), 4: (52, "Significant gaps before filing"), 5: (0, "Significant gaps before filing"),
    }
    costs = spark.range(1).select(*(scoring.code_penalty(F.lit(c), F.lit(k), F.lit(x)) for c, k, x in [("TOTAL_VALUE_PARSING_ERROR", "error", True), ("A", "warning", True), ("A", "warning", False), ("A", "info", False)])).first()
    assert list(costs) == [8, 12, 3, 0]
