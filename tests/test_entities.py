from __future__ import annotations

import random
import re

import pytest

from customsloom.operators import entities

FIELDS = "kind string, value string, phrase string, whole boolean, rank int"


def brute(text, dictionary, across=False):
    """Every phrase at every place, then leftmost and longest."""
    low, finds = (text or "").lower(), set()
    for kind, value, phrase, whole, rank in dictionary:
        p = phrase.strip().lower()
        for i in range(len(low) - len(p) + 1) if p else ():
            if low[i : i + len(p)] == p and not (whole and (re.match(r"\w", low[i - 1 : i]) if i else False)) and not (whole and re.match(r"\w", low[i + len(p) : i + len(p) + 1])):
                finds.add((i, -(i + len(p)), rank or 0, value, kind))
    out, ends = [], {}
    for i, e, _, value, kind in sorted(finds):
        if i >= ends.get("" if across else kind, 0):
            ends["" if across else kind] = -e
            out.append((kind, value, i, -e))
    return out


@pytest.mark.parametrize(("across", "most"), [(False, None), (True, None), (False, 200)])
def test_same_as_every_phrase_at_every_place(spark, across, most):
    rng = random.Random(1)
    letters = "abA _"
    dictionary = [(rng.choice("xy"), f"v{i % 9}", "".join(rng.choice(letters) for _ in range(rng.randint(1, 5))), rng.random() < 0.4, rng.randint(0, 3)) for i in range(25)]
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(120)] + [(900, None), (901, ""), (902, "İab a")]
    texts.append(texts[5])
    d = spark.createDataFrame([*dictionary, ("x", "v", " ", True, 0)], FIELDS)
    found = entities.spans(spark.createDataFrame(texts, "id int, text string").repartition(3), d, across, most)
    got = sorted((r["id"], [(s["kind"], s["value"], s["start"], s["stop"]) for s in r["spans"]]) for r in found.collect())
    want = sorted((i, brute(t if t is None or len(t.lower()) == len(t) else "iab a", dictionary, across)) for i, t in texts if i != 902)
    assert [g for g in got if g[0] != 902] == want and sum(len(w[1]) for w in want) > 100


def test_empty_tables(spark):
    texts, d = spark.createDataFrame([(1, "a man")], "id int, text string"), spark.createDataFrame([("x", "v", "man", True, None)], FIELDS)
    assert entities.spans(texts.limit(0), d).count() == 0
    assert [tuple(r) for r in entities.spans(texts, d.limit(0)).collect()] == [(1, [])]
    assert entities.flat_spans(entities.spans(texts, d)).first().asDict() == {"id": 1, "kind": "x", "value": "v", "start": 2, "stop": 5, "n": 1}


def test_models_and_their_words(spark):
    row = spark.createDataFrame([("MAN tgx 18.440 PN7094 and pn7094, 6ES7-214 MAN TGX 18",)], "t string").select(entities.model_spans(entities.F.col("t"), [f"(?i){p}" for p in entities.VEHICLE_MODELS] + entities.INDUSTRIAL_MODELS).alias("m"))
    got = row.first()["m"]
    assert got[0] == "tgx 18" and "18.440" in got and "PN7094" in got and "pn7094" not in got and len({x.lower() for x in got}) == len(got)
    assert row.select(entities.model_tokens(entities.F.array(entities.F.lit("PN7094"), entities.F.lit("tgx 18")), ("pn7094",))).first()[0] == ["18", "pn7094", "tgx"]


def test_what_follows_from_entities(spark):
    d = spark.createDataFrame([("vehicle_brand", "schmitz", "schmitz", True, 0), ("brand", "ifm", "ifm", True, 0), ("condition", "used", "rabljen", True, 1), ("condition", "new", "nov", True, 0), ("family", "ups", "ups", True, 0)], FIELDS)
    profiles = spark.createDataFrame([("trailer", ["87"], ["8716"], ["semi"]), ("sensor", ["90"], ["9026"], None)], "value string, chapters array<string>, headings array<string>, terms array<string>")
    texts = [(1, "rabljen Schmitz 2015"), (2, "IFM PN7094 senzor"), (3, "ifm controller plc"), (4, None), (5, "nov ups, rabljen")]
    rows = {
        r["id"]: r
        for r in entities.entities(
            spark.createDataFrame(texts, "id int, text string"), d, profiles, spark.createDataFrame([("schmitz", "trailer")], "brand string, vehicle string"), series=[("sensor", ("ifm",), r"\bPN\d+\b")], penalised=[("8543", ("ups",))]
        ).collect()
    }
    assert (rows[1]["vehicles"], rows[1]["headings"], rows[1]["condition"], rows[1]["is_vehicle"]) == (["trailer"], ["8716"], "used", True) and {"2015", "schmitz"} <= set(rows[1]["excluded"])
    assert rows[2]["families"] == ["sensor"] and rows[2]["is_sensor"] and "ifm" not in rows[2]["excluded"] and rows[2]["chapters"] == ["90"]
    assert (rows[3]["is_sensor"], rows[3]["is_automation"]) == (False, True) and (rows[4]["brands"], rows[4]["models"], rows[4]["is_vehicle"]) == ([], [], False)
    assert (rows[5]["condition"], rows[5]["penalised"], rows[5]["is_automation"]) == ("new", ["8543"], True)
