"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extracting anything.

A package is a ZIP file with stored (uncompressed) members ``archive/data.warc.gz``, whose records are gzip members of their
own, and ``indexes/index.cdxj``, which has the place of each record.  The reader finds the end of the central directory (and
its ZIP64 form), walks the directory, works out where the stored members' bytes begin, reads the index by its range, and then
deals single records out over tasks, each of which seeks and reads that record's bytes only.

Packages lie in the shared folder, one or more a task, under a name of the task's attempt; the table of packages has those of the
attempts that were committed, so what a lost or surplus attempt wrote isn't read.  Payload digests decide which records are revisits: a join on the digest with the groups that have
more than one record, which Spark can split where one payload has a great part of the rows.

Defined cases.  A null html is an empty payload, null urls have no target.  Of records with equal payloads of at least
``least_bytes`` bytes, those with the largest page id are responses and the others refer to it; null ids refer to it as well,
and are responses if no id is known.  Smaller payloads are all responses.  Repeated rows give a record each.  Other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from customsloom.llm.common import mounted, new_folder, written

#: A package is closed when its archive has so many bytes.
PACKAGE_BYTES = 256 << 20
#: Records of about so many bytes go to one reading task.
READ_BYTES = 8 << 20
#: Reading tasks at most; beyond, each reads more.
MOST_TASKS = 50_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response or revisit record.  A revisit has the response's head, with its length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC head, HTTP head, payload) of an uncompressed record; head names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_package(path: str, records: Iterator[tuple[str, bytes]]) -> tuple[int, int, tuple[str, bytes] | None]:
    """Writes records (key, bytes) until PACKAGE_BYTES; returns how many, their bytes, and the record that no longer fitted, if any."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp, index, at, left = f"{path}.{uuid.uuid4().hex}.tmp", [], 0, None
    with zipfile.ZipFile(tmp, "w", zipfile.ZIP_STORED) as package:
        with package.open(DATA, "w", force_zip64=True) as out:
            for key, raw in records:
                packed = _gzip(raw)
                if index and at + len(packed) > PACKAGE_BYTES:
                    left = (key, raw)
                    break
                out.write(packed)
                index.append(f"{key} 19700101000000 {json.dumps({'offset': at, 'length': len(packed), 'filename': DATA})}\n")
                at += len(packed)
        package.writestr(INDEX, "".join(index))
        package.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
    os.replace(tmp, path)
    return len(index), at, left


def central_directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """Member name to (first byte of its data, stored bytes, method).  ``read`` takes offset and length."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if tail[at - 20 : at - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        where = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
        far = read(where, 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", far[32:56])
    raw, out, at = read(start, length), {}, 0
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
        stored, full = struct.unpack("<II", raw[at + 20 : at + 28])
        name_n, extra_n, comment_n = struct.unpack("<HHH", raw[at + 28 : at + 34])
        local = struct.unpack("<I", raw[at + 42 : at + 46])[0]
        name = raw[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the values that don't fit 32 bits, in this order
                far = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = far.pop(0) if full == 0xFFFFFFFF else full
                stored = far.pop(0) if stored == 0xFFFFFFFF else stored
                local = far.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        head = read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        own_name, own_extra = struct.unpack("<HH", head[26:30])
        out[name] = (local + 30 + own_name + own_extra, stored, method)
        at += 46 + name_n + extra_n + comment_n
    return out


def _ranges(handle) -> Callable[[int, int], bytes]:
    def read(offset: int, length: int) -> bytes:
        handle.seek(offset)
        return handle.read(length)

    return read


def places(path: str) -> Iterator[tuple[int, int]]:
    """(offset in the package, bytes) of each record, from the stored index."""
    with open(path, "rb") as handle:
        read = _ranges(handle)
        members = central_directory(read, os.path.getsize(path))
        for name in (DATA, INDEX):
            if members[name][2]:
                raise ValueError(f"{name} isn't stored")
        start, size, _ = members[INDEX]
        for line in read(start, size).splitlines():
            entry = json.loads(line.split(b" ", 2)[2])
            yield members[entry["filename"]][0] + entry["offset"], entry["length"]


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes packages to the shared folder; returns their paths (package, records, bytes)."""
    folder = mounted(new_folder(pages.sparkSession, "packages"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= least_bytes).groupBy(F.col("sha1").alias("group_sha1")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(groups, (F.col("sha1") == F.col("group_sha1")) & (F.col("size") >= least_bytes), "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))

    def written_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                for page, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield str(page), record(page, url, payload, digest(payload), refers_to, refers_to is not None)

        # the attempt is in the name: a repeated task may get its rows in another order and cut packages elsewhere, and its files
        # must not replace some of those of the attempt that counts
        task, stream, k = TaskContext.get(), records(), 0
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        waiting = next(stream, None)
        while waiting is not None:
            path = f"{folder}/{name}-{k:04d}.wacz"

            def rest(first=waiting):
                yield first
                yield from stream

            n, size, waiting = write_package(path, rest())
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["package", "records", "bytes"])

    return written(rows.mapInArrow(written_by, "package string, records bigint, bytes bigint"), "packages")


def read(packages: DataFrame) -> DataFrame:
    """Range-reads all records of ``packages`` (package, bytes): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits)."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                found = list(places(path))
                # neighbours read together are one range list
                groups, size = [[]], 0
                for offset, length in found:
                    if size >= READ_BYTES:
                        groups.append([])
                        size = 0
                    groups[-1].append((offset, length))
                    size += length
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(groups)), pa.array([[o for o, _ in g] for g in groups], pa.list_(pa.int64())), pa.array([[n for _, n in g] for g in groups], pa.list_(pa.int64()))], ["package", "offsets", "lengths"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def number(text: str) -> int | None:
            text = text.removeprefix("<urn:page:").removesuffix(">")
            return int(text) if text else None

        for b in batches:
            for path, offsets, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                with open(path, "rb") as handle:
                    at = _ranges(handle)
                    for offset, length in zip(offsets, lengths, strict=True):
                        warc, http, payload = parse_record(zlib.decompress(at(offset, length), 31))
                        revisit = warc["warc-type"] == "revisit"
                        sha1 = warc["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and digest(payload) != sha1:
                            raise ValueError(f"{path} at {offset}: payload digest doesn't match")
                        rows.append((number(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], int(http["content-length"]), sha1, number(warc["warc-refers-to"]) if revisit else None, None if revisit else payload))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    ranges = packages.select("package").mapInArrow(located, "package string, offsets array<bigint>, lengths array<bigint>")
    size = packages.agg(F.sum("bytes")).first()[0] or 0
    ranges = ranges.repartition(min(MOST_TASKS, math.ceil(size / READ_BYTES) or 1), "package", F.get("offsets", F.lit(0)))  # a number: else few bytes of ranges go to one task
    return ranges.mapInArrow(fetched, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
