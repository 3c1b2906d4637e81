from __future__ import annotations

import json

from customsloom.sources import records
from customsloom.streaming import activity
from tests.conftest import SF


def test_aliases(spark):
    df = spark.createDataFrame([("SI", "6203", "hlače")], ["Izvoznik", "Carinska tarifa", "Opis blaga"])
    assert records.by_alias(df).first().asDict() == {"export_country": "SI", "import_country": None, "tariff": "6203", "description": "hlače", "net_mass": None}


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Transport_ID;Price\n1;2.5\n2;3.5\n", encoding="utf-8")
    got = records.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["transport_id", "price"] and got.count() == 2


def test_json_records_and_cases(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"description": "bolt", "code": "73181590"}, {"description": " ", "code": "1"}, {"description": "nut", "code": None}]}))
    assert [r["description"] for r in records.read_json_records(spark, str(tmp_path / "r.json")).collect()] == ["bolt"]
    for case in ("a", "b"):
        (tmp_path / "cases" / case).mkdir(parents=True)
        (tmp_path / "cases" / case / "x.json").write_text(json.dumps({"v": case}))
    assert {(r["case_id"], r["v"]) for r in records.read_cases(spark, str(tmp_path / "cases"), "x.json").collect()} == {("a", "a"), ("b", "b")}


def test_hierarchy(spark):
    rows = [(1, "62", 0, "Clothing"), (2, "6203", 0, "Suits"), (3, "", 1, "Trousers"), (4, "62034231", 2, "Of denim"), (5, "62034233", 2, "Cut corduroy"), (6, "", 1, "Jackets"), (7, "62033100", 2, "Of wool"), (8, "6204", 0, "Women's"), (9, "62041100", 1, "Of wool")]
    df = spark.createDataFrame(rows, "rownum int, code string, dashes int, title string").withColumn("code", __import__("pyspark.sql.functions", fromlist=["when"]).expr("CASE WHEN code = '' THEN '62' ELSE code END"))
    got = {r["cn_digits"]: r["hierarchy_path"] for r in records.nomenclature(df).collect()}
    assert got["62034231"] == "Suits > Trousers > Of denim"
    assert got["62033100"] == "Suits > Jackets > Of wool"
    assert got["62041100"] == "Women's > Of wool"


def test_items_of_documents(spark):
    doc = json.dumps({"items": [{"name": "Bolt", "qty": "1.400", "amount": "21,50", "hs": "7318 15 90", "origin": "SI"}, {"position_number": "7", "description": "Nut", "net_weight": "1,5"}]})
    got = [r.asDict() for r in records.items_of(spark.createDataFrame([(1, doc)], "id int, d string"), "d", "id").orderBy("ord").collect()]
    assert (got[0]["position"], got[0]["quantity"], got[0]["line_total"], got[0]["hs_code"]) == (1, 1400.0, 21.5, "73181590")
    assert (got[1]["position"], got[1]["description"], got[1]["net_weight"]) == (7, "Nut", 1.5)


def test_weighted_union_and_sample(spark):
    a = spark.createDataFrame([(1, "12345678"), (2, "1234")], "id int, cn8 string")
    out = records.weighted_union({"export": (a, 0.6), "import": (a, 0.4)})
    assert sorted((r["source"], r["weight"]) for r in out.collect()) == [("export", 0.6), ("import", 0.4)]
    ids = [r["id"] for r in records.hash_sample(spark.range(100).toDF("id"), "id", 10, 3).collect()]
    assert ids != sorted(ids) and len(set(ids)) == 10


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    import shutil

    table = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in" / "events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = activity.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM windows").collect())
    finally:
        q.stop()
    assert got == sorted(tuple(r) for r in activity.windowed(table).collect())
