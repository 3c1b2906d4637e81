from __future__ import annotations

import os
import textwrap

import pytest
from pyspark.sql import functions as F

from customsloom.llm import license_digests as ld
from customsloom.llm.license_texts import KNOWN
from tests.conftest import SF

COMMON = "/usr/share/common-licenses"
MIT = next(t for i, k, t in KNOWN if i == "MIT" and k == "text")


def test_query_equals_sql(spark, duck, same):
    got = ld.scan_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert same(got) == same(duck.sql(ld.oracle_sql()).df())


def test_entire_texts(spark):
    changed = MIT.replace("Copyright (c) <year> <copyright holders>", "# Copyright 2019-2024 Jane Roe\n(c) 2020 Other").replace("sublicense", "sub-licence").upper().replace("\n\n", "\n * ")
    rows = [(1, MIT), (2, changed), (3, MIT + " More."), (4, None), (5, ""), (6, "Copyright 2020 X"), (7, "Text.\nReleased under the MIT license\nLicensed under CC BY-NC 4.0."), (7, "Text.\nReleased under the MIT license\nLicensed under CC BY-NC 4.0."), (None, "plain"), (8, "word " * 50_000 + "\nSPDX-License-Identifier: MIT")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, license_id string")
    got = [(r["doc_id"], r["license_id"], r["notices"]) for r in ld.scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, ""), (7, None, "CC-BY-NC-4.0,MIT"), (7, None, "CC-BY-NC-4.0,MIT"), (None, None, ""), (8, None, "MIT")], key=str)
    digests = {r["doc_id"]: r["text_digest"] for r in ld.scan(docs).collect()}
    assert digests[4] is None and digests[5] == digests[6]


def test_every_known_text_finds_itself(spark):
    docs = spark.createDataFrame([(i, k, t) for i, k, t in KNOWN], "id string, kind string, text string")
    for r in ld.scan(docs).collect():
        assert (r["license_id"], r["license_kind"]) == (r["id"], r["kind"]) if r["kind"] != "notice" else r["id"] in r["notices"]


def test_line_breaks_do_not_matter(spark):
    """Every known text wrapped anew, and spellings, list signs and copyright lines that a break could hide."""
    rows = []
    for i, k, t in KNOWN:
        if k == "text":
            paragraphs = [p for p in t.split("\n\n") if not p.lower().startswith("copyright")]
            for width in (40, 60, 73):
                rows.append((i, "Copyright (c) 2020 A. Author\n\n" + "\n\n".join(textwrap.fill(p, width, initial_indent=" * ", subsequent_indent=" * ") for p in paragraphs)))
    got = ld.scan(spark.createDataFrame(rows, "id string, text string")).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["id"] for r in got)
    pairs = [("the copyright\nowner may", "the copyright holder may"), ("x\n(c) You must keep this", "x (c) you must keep this"), ("a non-\ncommercial b", "a noncommercial b"), ("a\nCopyright 2001 B\n© C\n(c) 1999 D\nb", "a b")]
    rows = [(i, t) for i, both in enumerate(pairs) for t in both]
    digests = ld.scan(spark.createDataFrame(rows, "id int, text string")).groupBy("id").agg(F.countDistinct("text_digest").alias("n")).collect()
    assert all(r["n"] == 1 for r in digests)
    assert ld.scan(spark.createDataFrame([(1, "x\n(c) You must keep this"), (2, "x")], "id int, text string")).select("text_digest").distinct().count() == 2


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="the published texts aren't on this machine")
def test_digests_of_published_texts(spark):
    rows = [(name, open(f"{COMMON}/{name}", encoding="utf-8", errors="replace").read()) for name in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")]
    rows += [("wrapped", "\n".join(textwrap.fill(x, 50) if not x.lower().lstrip().startswith("copyright") else x for x in rows[0][1].split("\n")))]
    got = {r["id"]: r["license_id"] for r in ld.scan(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "wrapped": "Apache-2.0"}


def test_a_table_of_known_digests_and_clashing_names(spark):
    known = ld.known_digests(spark, [("Own-1", "text", "All may use this work."), ("Own-1", "notice", "Own licence")], [])
    docs = spark.createDataFrame([(1, "all may\nuse this work", "k", 1, 2, 3), (2, "See the own licence.\nOWN LICENCE!", "k", 1, 2, 3)], "doc_id bigint, text string, key string, lines int, named int, HIT int")
    out = ld.scan(docs, known)
    assert set(docs.columns) < set(out.columns) and len({c.lower() for c in out.columns}) == len(out.columns)
    assert [(r["license_id"], r["notices"], r["HIT"]) for r in out.orderBy("doc_id").collect()] == [("Own-1", "", 3), (None, "Own-1", 3)]


def test_no_known_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, MIT)], "doc_id bigint, text string")
    assert ld.scan(docs, ld.known_digests(spark).where("false")).first()["license_id"] is None
    assert ld.scan_documents(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="more than"):
        ld.known_digests(spark, [("x", "text", "y")] * (ld.MOST_KNOWN + 1))


def test_the_plan_has_no_python(spark):
    plan = ld.scan_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None
