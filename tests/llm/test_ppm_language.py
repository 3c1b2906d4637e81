from __future__ import annotations

import math

import numpy as np
import pytest

from customsloom.llm import ppm_language as ppm
from customsloom.llm.common import U64
from tests.conftest import SF


def brute_bits(train: bytes, context: bytes, byte: int, order: int) -> float:
    """PPM method C with exclusion, straight from the text."""
    cost, out = 0.0, set()
    padded = b" " * order + train
    for j in range(order, -1, -1):
        c = context[len(context) - j :] if j else b""
        seen: dict[int, int] = {}
        for i in range(order, len(padded)):
            if padded[i - j : i] == c:
                seen[padded[i]] = seen.get(padded[i], 0) + 1
        left = {b: n for b, n in seen.items() if b not in out}
        if left:
            total, kinds = sum(left.values()), len(left)
            if byte in left:
                return cost - math.log2(left[byte] / (total + kinds))
            cost -= math.log2(kinds / (total + kinds))
            out |= set(left)
    return cost + math.log2(256 - len(out))


def test_code_lengths_equal_brute_force_and_sum_to_one():
    train = b"abracadabra abra cadabra bacaba"
    data, offsets = np.frombuffer(train, np.uint8), np.array([0, len(train)])
    runs, n = np.unique(ppm.contexts(data, offsets, 3), return_counts=True)
    tree = ppm.Tree.of(runs, n.astype(float), 3)
    for context in (b"abr", b"zza", b"   ", b"xyz"):
        keys = np.arange(256, dtype=U64) + U64(int.from_bytes(context, "big") << 8)
        bits = tree.bits(keys)
        assert (2.0**-bits).sum() == pytest.approx(1)
        for byte in (ord("a"), ord("c"), ord("z"), 0):
            assert bits[byte] == pytest.approx(brute_bits(train, context, byte, 3))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = ppm.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got[got.held_out].shape[0] > 10
    own = got[got.lang_pred != "und"]
    assert (own.lang == own.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "a"), (2, "der hund und die katze", "de", "b"), (3, None, "en", "c"), (4, "", None, "d"), (5, "12 !!", "de", "e"), (None, "die und der", None, "f"), (2, "der hund und die katze", "de", "b"), (6, "дом", "en", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    got = ppm.predict(docs, ppm.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"] and by[3]["score"] == 0.0 and by[None]["lang_pred"] == "de" and by[6]["lang_pred"] != "und"
    kept = ppm.keep_identified(docs, ppm.fit(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None, 6}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id bigint, text string, lang string")
    assert ppm.identify(docs).first()["lang_pred"] == "und"
    assert ppm.identify(docs.where("false")).count() == 0
    several = spark.createDataFrame([(1, "words", None), (2, "12 !", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert [r["doc_id"] for r in ppm.keep_identified(several, ppm.fit(several)).collect()] == [1]


def test_query_equals_brute_force(spark):
    """Language, score and fold of every row, with code lengths worked out byte by byte from the training texts."""
    import zlib

    texts = {"en": ["the cat sat", "a dog and the hat", "on the mat"], "de": ["der hund und", "die katze sass", "auf der matte"], "fr": ["le chat et", "la table du", "les chiens"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    rows += [(20 + i, t, lang) for i, (t, lang) in enumerate([("the dog sat on", None), ("und die matte", "de"), ("la", "fr"), ("zq x", "en"), ("!?", "en"), (None, "de")])]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    train = {lang: [t for i, t, x in rows if x == lang and i not in held and t] for lang in texts}

    def bits(t: bytes, lang: str) -> float:
        whole = b"".join(b"   " + x.encode() for x in train[lang])
        total = 0.0
        for i in range(len(t)):
            seen, out, cost, done = (b"   " + t)[: i + 3], set(), 0.0, False
            for j in range(3, -1, -1):
                c, found = seen[len(seen) - j :] if j else b"", {}
                at = 0
                for x in train[lang]:
                    at += 3
                    for k in range(at, at + len(x.encode())):
                        if whole[k - j : k] == c:
                            found[whole[k]] = found.get(whole[k], 0) + 1
                    at += len(x.encode())
                left = {b: n for b, n in found.items() if b not in out}
                if left:
                    room = sum(left.values()) + len(left)
                    if t[i] in left:
                        cost, done = cost - math.log2(left[t[i]] / room), True
                        break
                    cost -= math.log2(len(left) / room)
                    out |= set(left)
            total += cost if done else cost + math.log2(256 - len(out))
        return total

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for r in ppm.identify(docs).collect():
        t = next(t for i, t, _ in rows if i == r["doc_id"])
        assert r["held_out"] == (r["doc_id"] in held)
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        length = {lang: bits(t.encode(), lang) for lang in sorted(texts)}
        best = min(length, key=length.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(2 ** (length[best] - x) for x in length.values()), rel=1e-4)
        assert r["bits_per_byte"] == pytest.approx(length[best] / len(t.encode()), rel=1e-5)
