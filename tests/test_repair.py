from __future__ import annotations

import random

from customsloom.operators import repair

WORDS = ["Čakovec", "Križevci", "Varaždin", "Đakovo", "Ćuprija", "Niš", "Kruševac", "Živinice", "Čitluk", "Žalec", "Črnomelj", "kruška", "čaša", "leđa", "noć", "kuća", "žaba", "šuma", "mreža", "očaj", "riječi", "građa"]
MAP = {"č": "\x01", "š": "\x02", "đ": "\x03", "ć": "\x04", "ž": "\x05"}


def broken(text, by):
    return "".join(by.get(c, by.get(c.lower(), c)) for c in text)


def maps(spark, texts, known=None):
    df = spark.createDataFrame(texts, "id int, source string, text string")
    own = None if known is None else spark.createDataFrame(known, "source string, sign string, letter string")
    return df, repair.maps(df, spark.createDataFrame([(w,) for w in WORDS], "word string"), own)


def test_each_source_has_its_own_map_and_other_words_are_repaired_too(spark):
    other = dict(zip(MAP, ["\x0e", "\x01", "\x1a", "\x03", "\x08"], strict=True))
    rng = random.Random(3)
    clean = [(i, "ab"[i % 2], " ".join(rng.choices(WORDS, k=12)) + ", Čačak čežnja\n\tŽUŽELJČE đak!") for i in range(30)]
    texts = [(i, s, broken(t, MAP if s == "a" else other)) for i, s, t in clean]
    df, found = maps(spark, [*texts, (90, "b", None), (91, "a", ""), (92, "c", "whole"), (93, None, "ku\x07a no\x07 vo\x07ka"), (93, None, "ku\x07a")])
    got = {(r["source"], r["sign"]): r["letter"] for r in found.collect()}
    assert got == {("a", s): c for c, s in MAP.items()} | {("b", s): c for c, s in other.items()} | {(None, "\x07"): "ć"}
    out = repair.repaired(df, found)
    done = {r["id"]: r["text"] for r in out.where("id < 90").collect()}
    assert all(done[i].lower() == t.lower() for i, _, t in clean)  # small and capital letters have one sign here
    rest = {r["id"]: r["text"] for r in out.where("id BETWEEN 90 AND 92").collect()}
    assert rest == {90: None, 91: "", 92: "whole"} and sorted(r["text"] for r in out.where("id = 93").collect()) == ["kuća", "kuća noć voćka"]


def test_known_maps_hold_and_what_nothing_settles_is_reported(spark):
    df, found = maps(spark, [(1, "a", "ku\x04a gra\x06a xq\x07z \x02uma"), (2, "z", "ab\x05c")], [("a", "\x04", "š"), ("z", "\x05", "")])
    got = {(r["source"], r["sign"]): r["letter"] for r in found.collect()}
    assert got[("a", "\x04")] == "š" and got[("z", "\x05")] == "" and got.get(("a", "\x06")) in ("đ", None) and ("a", "\x02") not in got  # š is taken
    out = repair.repaired(df, found)
    rows = {r["id"]: r for r in out.collect()}
    assert rows[2]["text"] == "abc" and rows[1]["text"].startswith("kuša") and "\x07" in rows[1]["unknown"] and rows[1]["signs"] == ["\x02", "\x04", "\x06", "\x07"]
    report = {r["sign"]: (r["source"], r["rows"]) for r in repair.unknown_signs(out).collect()}
    assert report["\x07"] == ("a", 1)


def test_signs_that_are_nothing(spark):
    _, found = maps(spark, [(i, "a", "kr\x11uška šu\x11ma gr\x11ađa ze\x11mlja") for i in range(3)])
    assert [(r["sign"], r["letter"]) for r in found.collect()] == [("\x11", "")]


def test_propagation(spark):
    sets = [((("s", "a"),), 5.0), ((("t", "a"),), 4.0), ((("t", "b"), ("u", "c")), 1.2), ((("u", "d"),), 0.7), ((("v", ""),), 9.0), ((("v", "e"),), 0.5)]
    assert {s: c for s, (c, _) in repair.settle(sets, {}).items()} == {"s": "a", "t": "b", "u": "c"}  # t isn't a, so it is b, and with it u is c; v is left open
    assert repair.settle([], {"x": "y"}) == {"x": ("y", 0.0)}


def test_empty_tables(spark):
    df, found = maps(spark, [(1, "a", "kuća")])
    assert found.count() == 0 and repair.repaired(df.limit(0), found).count() == 0


def test_tokens_that_may_be_either_letter_tell_nothing_and_the_others_settle():
    both = [((("s", "a"),), (("s", "b"),))]  # by shares alone a has 60 votes and b 50, which is no margin
    assert repair.settle_choices([(list(both[0]), 100.0), ([(("s", "a"),)], 10.0)], {}) == {"s": ("a", 60.0)}
    assert repair.settle_choices([(list(both[0]), 100.0), ([(("s", "a"),)], 5.0), ([(("s", "b"),)], 4.0)], {}) == {}
    assert repair.settle_choices([(list(both[0]), 100.0)], {"t": "b"}) == {"t": ("b", 0.0), "s": ("a", 100.0)}  # what falls leaves its votes to the rest
