"""Hierarchies, attributes and reasons."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from customsloom.operators import attributes, hierarchy, provenance


def test_paths_of_any_depth(spark):
    rng = random.Random(2)
    rows = [("n0", None, "t0")] + [(f"n{i}", f"n{i - 1}", f"t{i}") for i in range(1, 90)]  # a chain
    rows += [(f"m{i}", rng.choice(["n3", "n50", *[f"m{j}" for j in range(i)]]), f"u{i}") for i in range(60)]
    rows += [("x", "gone", "orphan"), ("y", "x", None), ("a", "b", "A"), ("b", "c", "B"), ("c", "a", "C"), ("d", "a", "D"), ("e", "e", "E"), ("n5", "zz", "later"), (None, "n1", "none")]
    parents = {}
    for c, p, t in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[1] or "", r[2] or "")):
        parents.setdefault(c, (p, t))
    want = {}
    for c in parents:
        path, at, status = [], c, "ok"
        while at is not None and status == "ok":
            if at not in parents:
                status = "orphan"
            elif len(path) > len(parents):
                status, path = "cycle", None
            else:
                path.insert(0, parents[at][1])
                at = parents[at][0]
        want[c] = (status, path)
    got = {r["code"]: (r["status"], r["path"]) for r in hierarchy.paths(spark.createDataFrame(rows, "code string, parent string, title string")).collect()}
    assert got == want and len(got["n89"][1]) == 90 and got["d"] == ("cycle", None) and got["y"] == ("orphan", ["orphan", None])
    assert hierarchy.paths(spark.createDataFrame([], "code string, parent string, title string")).count() == 0


def test_titles(spark):
    path = ["Articles of apparel, not knitted", "Men's or boys' suits and ensembles (other than swimwear)", "Other", "Of cotton"]
    row = spark.createDataFrame([(path, ["diesel engines of all kinds", "Electric static converter units"], [" Other ", "Of wool"])], "p array<string>, q array<string>, r array<string>")
    none = F.array().cast("array<string>")
    terms = lambda *xs: F.array(*map(F.lit, xs))
    got = row.select(
        hierarchy.heading(F.col("p"), none, none), hierarchy.heading(F.col("q"), terms("CONVERTER"), terms("diesel")), hierarchy.heading(F.col("q"), none, terms("e")), hierarchy.heading(F.col("r"), none, none), hierarchy.heading(F.array().cast("array<string>"), none, none),
        hierarchy.combined(F.lit("Suits"), F.lit("Of cotton"), F.col("p")), hierarchy.combined(F.lit("Cotton suits"), F.lit("cotton"), F.col("p")), hierarchy.combined(F.lit(""), F.lit("Of denim"), F.col("p")), hierarchy.combined(F.lit("Suits"), F.lit(" "), F.col("p")), hierarchy.combined(F.lit("Suits"), F.lit("other, of wool"), F.col("p")),
    ).first()
    assert list(got) == [path[1], "Electric static converter units", "Electric static converter units", "Other", "", "Suits, of cotton", "Cotton suits", f"{path[1]}: Of denim", "Suits", "Suits, of other, of wool"]


def test_attributes(spark):
    df = spark.createDataFrame([("Women's COTTON trousers", {"fabric": " Denim "}), ("bombažne majice", None), (None, {"gender": ""})], "t string, s map<string,string>")
    got = [r[0] for r in df.select(attributes.detect(F.col("t"), F.col("s"))).collect()]
    assert got == [{"gender": "female", "material": "cotton", "fabric": "denim", "construction": "woven"}, {"material": "cotton"}, {}]
    assert [r[0] for r in df.select(attributes.answers(attributes.detect(F.col("t")))).collect()] == [{"textile_construction": "woven", "apparel_gender": "womens"}, {}, {}]


def test_merge_keeps_who_won(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": " "}, {"a": "y", "b": "z"}, 0.9, {"a": "x", "c": "w"}), (2, None, {"a": "y"}, 0.5, {"a": "q"}), (3, {"a": "x"}, {"a": "x"}, None, None)], "i int, u map<string,string>, m map<string,string>, conf double, d map<string,string>")
    merged = attributes.merge([attributes.Source("user", F.col("u")), attributes.Source("auto", F.col("m"), F.col("conf"), attributes.AUTOMATIC), attributes.Source("seen", F.col("d"))])
    got = {r[0]: {k: tuple(v) for k, v in r[1].items()} for r in df.select("i", merged).collect()}
    assert got == {1: {"a": ("x", "user", ["auto"]), "b": ("z", "auto", []), "c": ("w", "seen", [])}, 2: {"a": ("q", "seen", [])}, 3: {"a": ("x", "user", [])}}
    assert df.select(attributes.by_source(merged, "auto")).first()[0] == ["b"]


def test_reasons_add_up(spark):
    rows = [(1, 5, 0.9, 1.0, True), (1, 1, 0.9, 1.0, True), (1, 5, 0.1, 0.0, True), (2, 3, 0.2, 0.0, True), (2, 4, 0.3, 0.7, False), (2, None, 0.9, 1.0, True), (4, 9, 0.8, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, declarations int, confidence double, country_match double, ok boolean")
    out = {r["id"]: r for r in provenance.reasons(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int"), provenance.traced(df, provenance.knowledge_filters(2, 0.55, F.col("ok"))), "id", [F.col("confidence")]).collect()}
    assert [(out[i]["candidates"], out[i]["kept"], out[i]["reason"], out[i]["best0"]) for i in (1, 2, 3, 4)] == [(3, 1, "kept", 0.9), (3, 0, "confidence_below_threshold", 0.3), (0, 0, "no_fts_match", None), (1, 0, "taxonomy_rejected", 0.8)]
    assert all(sum((out[i]["by_reason"] or {}).values()) == out[i]["candidates"] for i in out) and out[2]["by_reason"] == {"confidence_below_threshold": 1, "country_mismatch": 1, "declaration_count_below_threshold": 1}
