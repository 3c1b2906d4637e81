from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from customsloom.llm import warc_zip as wz
from tests.conftest import SF


def expected(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = max(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        own = first.get(h or "") if len(b) >= least and sum((x or "") == (h or "") for _, x in rows) > 1 else None
        revisit = own is not None and own != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", own if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip_of_odd_rows(spark, least):
    rows = [(1, "u://a", "x" * 10, 1), (5, "u://b", "x" * 10, 1), (5, "u://b", "x" * 10, 1), (2, None, None, 1), (3, "u\r\nEvil: 1", "", 1), (4, "u", "é&<p>", 1), (None, "u", "é&<p>", 1), (None, "n", "alone", 1), (9, "l", "long " * 300_000, 1), (11, "s", "ab", 1), (12, "s", "ab", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")
    got = wz.read(wz.write(pages, least_bytes=least))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == expected([(i, h) for i, _, h, _ in rows], least)
    texts = {(r["page_id"], r["payload"].decode()) for r in got.collect() if r["payload"] is not None}
    assert (4, "é&<p>") in texts or (None, "é&<p>") in texts


def test_pages_and_their_copies(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionAll(pages.select((F.col("page_id") + 1000).alias("page_id"), "url", "html").where("page_id % 3 = 0"))
    got = wz.round_trip(pages)
    assert sorted(map(tuple, got.collect()), key=str) == expected([(r["page_id"], r["html"]) for r in pages.collect()])


def test_attempts_in_another_order_lose_and_double_nothing(spark, monkeypatch):
    """Each task's rows come again in reverse, as after a lost executor; of two whole attempts the table of one counts."""
    rows = [(i, f"u{i}", "same" if i % 3 else f"page {i} " * 40) for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = wz.new_folder(spark, "again")
    monkeypatch.setattr(wz, "new_folder", lambda *_: folder)
    monkeypatch.setattr(wz, "READ_BYTES", 1_000)
    first = wz.write(pages)
    second = wz.write(pages.orderBy(F.desc("page_id")))
    names = [{r["package"] for r in t.collect()} for t in (first, second)]
    assert names[0] and names[1] and not names[0] & names[1]
    want = expected([(i, h) for i, _, h in rows])
    for packages in (first, second):
        got = wz.read(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert got.rdd.getNumPartitions() > 1


def test_empty_table(spark):
    assert wz.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("far", [False, True])
def test_directory_of_plain_and_zip64_packages(monkeypatch, far):
    if far:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("a/é.txt", b"first"), ("b.bin", b"second" * 20), ("c", b"")):
            with z.open(name, "w", force_zip64=far) as f:
                f.write(data)
        z.comment = b"PK a comment"
    data = raw.getvalue()
    found = wz.central_directory(lambda o, n: data[o : o + n], len(data))
    assert {k: data[at : at + n] for k, (at, n, _) in found.items()} == {"a/é.txt": b"first", "b.bin": b"second" * 20, "c": b""}


def test_broken_packages_are_refused():
    with pytest.raises(ValueError, match="central directory"):
        wz.central_directory(lambda o, n: b"nothing here"[o : o + n], 12)


def test_a_package_that_is_full_goes_on_in_the_next(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(wz, "PACKAGE_BYTES", 400)
    stream = iter((str(i), wz.record(i, "u", bytes(range(200)), "D", None, False)) for i in range(4))
    n, _, left = wz.write_package(str(tmp_path / "p.wacz"), stream)
    assert n >= 1 and left is not None and left[0] == str(n)
    assert len(list(wz.places(str(tmp_path / "p.wacz")))) == n
