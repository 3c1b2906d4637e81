"""How plans shuffle and what they broadcast."""

from __future__ import annotations

from customsloom.operators import hierarchy, rollup


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_sends_each_line_once(spark):
    rows = [(1, "a", "YES", 1.0, None, "SI"), (1, "a", "NO", 2.0, 1.5, "AT"), (1, None, "NO", 1.0, None, "AT"), (1, "b", None, 1.0, None, None), (2, None, None, 1.0, None, None)]
    df = spark.createDataFrame(rows, "invoice_id int, hs_code string, preference string, line_total double, net_weight double, country string")
    out = rollup.declaration_summary(df, "invoice_id")
    assert "Expand" not in planned(out) and out.schema["unique_hs_codes"].dataType.simpleString() == "bigint"
    assert [tuple(r) for r in out.orderBy("invoice_id").collect()] == [(1, 4, 2, 2, 5.0, 1.5, "AT, SI"), (2, 1, 0, 0, 1.0, None, "")]


def test_tables_of_all_nodes_are_not_broadcast(spark, monkeypatch):
    plans, stored = [], hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda df, name: plans.append(planned(df)) or stored(df, name))
    out = hierarchy.paths(spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, 3, "c")], "code int, parent int, title string"))
    assert {r["code"]: r["path"] for r in out.collect()}[4] == ["r", "a", "b", "c"]
    assert plans and not any("Broadcast" in p for p in plans)
