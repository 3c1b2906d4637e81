from __future__ import annotations

import math

from customsloom.operators import rollup

LINES = "invoice_id int, description string, hs_code string, preference string, quantity double, line_total double, net_weight double, country string"
DOCUMENTS = "invoice_id int, shipment_weight double, gross_weight double, canonical_total double"


def report(spark, lines, documents):
    groups = rollup.tariff_groups(spark.createDataFrame([(k, d, *rest) for k, d, *rest in lines], LINES))
    docs = spark.createDataFrame(documents, DOCUMENTS)
    rows = {(r["invoice_id"], r["section"], r["hs_code"], r["preference"]): r for r in rollup.tariff_report(groups, docs).collect()}
    return rows, {r["invoice_id"]: r for r in rollup.invoice_summary(groups, docs).collect()}


def test_weights_are_dealt_where_all_goods_are_alike(spark):
    lines = [(1, "steel bolts", c, "YES", 1.0, v, None, "SI") for c, v in (("1", 10.0), ("2", 10.0), ("3", 10.0))] + [(2, "steel bolts", "1", "YES", 1.0, 5.0, None, "SI"), (2, "steel nuts", "2", "NO", 1.0, 5.0, None, None)]
    rows, sums = report(spark, lines, [(1, 10.0, 11.0, None), (2, 10.0, None, 99.999)])
    assert [rows[1, "preferential", c, "YES"]["total_net_weight"] for c in "123"] == [3.333, 3.333, 3.334]
    assert [rows[1, "codes", c, "YES"]["total_net_weight"] for c in "123"] == [3.333] * 3
    assert rows[2, "preferential", "1", "YES"]["weight_unavailable"] and rows[2, "non_preferential", "2", "NO"]["total_net_weight"] is None and not rows[2, "codes", "1", "YES"]["weight_unavailable"]
    assert (sums[1]["total_invoice_value"], sums[1]["total_gross_weight"], sums[1]["total_net_weight"]) == (30.0, 11.0, 10.0) and sums[2]["total_invoice_value"] == 100.0


def test_undeclared_goods_are_one_row(spark):
    lines = [(1, "steel bolts", "1", None, 2.0, 1.5, None, "SI"), (1, "steel nuts", "2", "NOT_DECLARED", 1.0, 1.5, None, "AT"), (1, "steel nuts", "2", "NOT_DECLARED", 1.0, 1.0, None, " ")]
    lines += [(2, "steel bolts", "1", "UNKNOWN", 1.0, 1.0, -2.0, None), (2, "steel bolts", "1", "NOT_DECLARED", 1.0, 1.0, 3.0, None)]
    rows, sums = report(spark, lines, [(1, 8.0, None, 0.0)])
    one = rows[1, "non_preferential", rollup.EXPORT_CODE, "NOT_DECLARED"]
    assert (one["total_quantity"], one["total_value"], one["total_net_weight"], one["item_count"], one["countries_of_origin"]) == (4.0, 4.0, 8.0, 3, "AT, SI")
    assert {k[1] for k in rows if k[0] == 1} == {"codes", "non_preferential"} and {k[1:] for k in rows if k[0] == 2} == {("codes", "1", "UNKNOWN"), ("codes", "1", "NOT_DECLARED"), ("unknown", "1", "UNKNOWN"), ("unknown", "1", "NOT_DECLARED")}
    assert rows[2, "codes", "1", "UNKNOWN"]["total_net_weight"] is None and rows[2, "unknown", "1", "UNKNOWN"]["total_net_weight"] == -2.0
    assert sums[1]["unique_hs_codes"] == 2 and sums[2]["total_net_weight"] == 1.0


def test_other_lines_nulls_and_empty_tables(spark):
    lines = [(1, "Transport costs", "1", "YES", 1.0, 5.0, 1.0, "SI"), (1, None, "1", "YES", 1.0, 5.0, 1.0, "SI"), (1, "steel bolts", None, "YES", None, None, None, None), (2, "steel bolts", "1", "YES", None, None, None, None), (None, "steel bolts", "1", "NO", 1.0, 1.0, 1.0, "SI")]
    rows, sums = report(spark, lines, [(1, 5.0, 5.0, 5.0), (2, 7.0, None, None)])
    assert not [k for k in rows if k[0] == 1] and (sums[1]["total_goods_lines"], sums[1]["excluded_service_lines"], sums[1]["unique_hs_codes"], sums[1]["countries_of_origin"]) == (2, 1, 0, "")
    assert rows[2, "codes", "1", "YES"]["total_net_weight"] is None and rows[2, "preferential", "1", "YES"]["total_net_weight"] == 7.0 and sums[2]["total_invoice_value"] == 0.0
    assert rows[None, "non_preferential", "1", "NO"]["item_count"] == 1
    assert report(spark, [], []) == ({}, {})


def test_lines_are_read_and_grouped_once(spark):
    groups = rollup.tariff_groups(spark.createDataFrame([(1, "steel bolts", "1", "NOT_DECLARED", 1.0, 1.0, None, "SI")], LINES))
    plan = rollup.tariff_report(groups, spark.createDataFrame([(1, 1.0, 1.0, 1.0)], DOCUMENTS))._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ObjectHashAggregate") == 2 and plan.count("Sort [") == 3  # of the join's two sides, and once for all windows


def test_undeclared_invoices_of_many_groups(spark):
    lines = [(k, "steel bolts", str(c), "NOT_DECLARED", 1.0, 0.125, w, o) for k, w in ((1, None), (2, 0.5), (None, 0.25)) for c in range(40) for o in ("SI", "AT", None)[: 1 + c % 3]]
    rows, _ = report(spark, lines, [(1, 7.0, None, None), (2, 7.0, None, None)])
    n = sum(1 + c % 3 for c in range(40))
    for k, weight in ((1, 7.0), (2, n * 0.5), (None, n * 0.25)):
        one = rows[k, "non_preferential", rollup.EXPORT_CODE, "NOT_DECLARED"]
        assert (one["total_quantity"], one["total_value"], one["total_net_weight"], one["item_count"], one["countries_of_origin"]) == (float(n), math.floor(n * 12.5 + 0.5) / 100, weight, n, "AT, SI")
    assert len(rows) == 3 * 41
