from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict

import pytest

from customsloom.llm import token_links
from tests.conftest import SF
from tests.llm.helpers import text

pytest.importorskip("tokenizers")
PATHS = token_links.tokenizer_paths()


def brute(docs):
    """Whole texts through both tokenizers, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    signs = token_links._byte_signs()
    each = []
    for doc, t in docs:
        groups = []
        if t:
            ia, ib = a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)
            wa = [bytes(signs[c] for c in a.id_to_token(i)) for i in ia]
            wb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(wa) == b"".join(wb) == b" " + t.encode():
                x = y = at_a = at_b = 0
                ga, gb = [], []
                while x < len(ia) or y < len(ib):
                    if at_a <= at_b:
                        ga.append(ia[x])
                        at_a += len(wa[x])
                        x += 1
                    else:
                        gb.append(ib[y])
                        at_b += len(wb[y])
                        y += 1
                    if at_a == at_b and ga and gb:
                        groups.append((ga, gb))
                        ga, gb = [], []
        each.append((doc, groups))
    counts = Counter()
    for _, groups in each:
        counts.update({(i, j) for ga, gb in groups for i in ga for j in gb})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for doc, groups in each:
        links = [(i, j) for ga, gb in groups for i in ga for j in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b"), (5, " lead"), (6, "trail "), (7, "tab\there\nand  two \n lines"), (8, "<|endoftext|> <s> </s><unk> x"), (9, "▁ a ▁b"), (10, "café naïve Über"),
    (11, "你好 世界 한국"), (12, "a b c　d e f"), (13, "x" * 3000 + " " + "9" * 500), (14, "it's we'll I'D don't"), (15, "a\x00b \x1c c"), (16, "\U0001f600 \U0001f469‍\U0001f4bb ok"), (17, "ﬁ ½ Å İ"),
    (18, "é क्ष กำ"), (19, "a.b , c! (d) [e] 12,345.67 $5"), (None, "café it's"), (4, "a  b"), (20, "﻿bom   line\r\nnext"), (21, "  \n\n  deep   spaces\t\t"), (22, "word " * 30_000),
]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(token_links, "REMEMBERED", 40)
    monkeypatch.setattr(token_links, "RUN_CHARS", 200)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "doc_id bigint, text string, PAIR int").repartition(3)
    assert rows(token_links.align_documents(df)) == brute(ODD)
    assert token_links.align_documents(df.limit(0)).count() == 0
    assert token_links.align_documents(df.where("doc_id < 3")).agg({"n_links": "sum"}).first()[0] == 0


def test_query_is_the_same_as_whole_texts(spark):
    from customsloom.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_token_links"](spark, SF)) == brute(docs)


def test_relational_plan_gives_the_same_links(spark):
    docs = [(i, t) for i, t in enumerate(t for _, t in ODD) if t] + [(100 + i, text(i, 60)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    plan = token_links.relational(df, PATHS)
    links = {r["uid"]: (r["g"], r["n"]) for r in plan.links.groupBy("uid").agg({"grp": "max", "*": "count"}).toDF("uid", "g", "n").collect()}
    want = {r[0]: (r[3] - 1, r[4]) for r in brute(docs) if r[4]}
    assert links == want and plan.tokens.where("side = 'a'").count() == sum(r[1] for r in brute(docs))


def test_groups_written_out_give_back_the_text(spark):
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    with open(PATHS[0].replace(".json", ".tiktoken"), "rb") as f:
        a = {int(i): base64.b64decode(w) for w, i in map(bytes.split, f)}
    docs = [(1, "Der schnelle naïve fox 12,345"), (2, text(3, 200))]
    for r in token_links.align_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), written_out=True).collect():
        groups = [g.split("|") for g in r["groups"].split(";")]
        assert b"".join(a[int(i)] for g in groups for i in g[0].split(",")).decode() == " " + docs[r["doc_id"] - 1][1]
        assert b.decode([int(i) for g in groups for i in g[1].split(",")]) == docs[r["doc_id"] - 1][1]
