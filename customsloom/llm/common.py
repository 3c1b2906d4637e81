"""Shared pieces of the training-data operators: the shared folder, whole-batch tokenising in numpy, hashing.

Everything here works on an Arrow batch of texts at once.  A batch is one UTF-8 byte buffer with offsets, so
tokenising and hashing cost a few numpy passes over the bytes and no Python loop over words or documents.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that are worked on at once; bounds the temporary arrays of a task to some tens of MB.
BLOCK_BYTES = 1 << 19
#: Most bytes and rows of an Arrow batch that goes to a worker where texts are long (``bounded_batches``).
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
_MULT, _MULT_INV = 0x9E3779B97F4A7C15 | 5, pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``); a local one is set where none is, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loom-shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder name in the shared folder (not yet created)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def mounted(uri: str) -> str:
    """The path under which every worker sees a shared folder.  Memory maps and range reads need a mounted file system."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: memory-mapped and range-read files need spark.checkpoint.dir on a mounted (file:) path")
    return parts.path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at  # type: ignore[attr-defined]
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing will read again; others are left alone."""
    for df in tables:
        if (at := getattr(df, "written_at", None)) is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Lets Arrow batches hold at most BATCH_BYTES and BATCH_ROWS, for rows with one or two whole texts: the session's limits go down, not up."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # one with a unit is the user's own
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df doesn't have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (splitmix)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, base, U64), out=out[1:])
    return out


_BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_pow_cache: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow_cache or len(_pow_cache[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _pow_cache[:] = [_powers(_MULT, size), _powers(_MULT_INV, size)]
    return _pow_cache[0], _pow_cache[1]


@dataclass
class Tokens:
    """The tokens of a block of texts, in order."""

    hashes: np.ndarray  # uint64, one per token
    doc_start: np.ndarray  # int64, texts + 1: token range of each text
    begin: np.ndarray  # byte range of each token in data
    end: np.ndarray
    data: np.ndarray

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_start) - 1), np.diff(self.doc_start))


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``most`` bytes; a null text is empty.

    A text longer than ``most`` makes a block of its own; no text is cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[48:58] = _NOT_WORD[65:91] = _NOT_WORD[97:123] = _NOT_WORD[128:] = False


def tokenise(data: np.ndarray, offsets: np.ndarray, words_only: bool = False, lower: bool = True) -> Tokens:
    """Tokens of a block with 64-bit hashes of their bytes, A-Z lower-cased unless ``lower`` is off.

    words_only=False: maximal runs of non-space bytes (space is 0x20 and 0x09-0x0D).
    words_only=True: maximal runs of ASCII letters, digits and non-ASCII bytes.
    """
    data = _LOWER[data] if lower else data
    gap = (_NOT_WORD if words_only else _SPACE)[data]
    n = len(data)
    inner = offsets[1:-1][offsets[1:-1] < n]
    solid = ~gap
    first = solid.copy()
    first[1:] &= gap[:-1]
    last = solid.copy()
    last[:-1] &= gap[1:]
    if len(inner):
        first[inner] = solid[inner]
        at = inner[inner > 0] - 1
        last[at] = solid[at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc_start = np.searchsorted(begin, offsets)
    if not len(begin):
        return Tokens(np.zeros(0, U64), doc_start, begin, end, data)
    power, inverse = _pow(n + 1)
    with np.errstate(over="ignore"):
        value = _BYTE_HASH[data]
        value *= power[:n]
        value[gap] = 0
        hashes = np.add.reduceat(value, begin) * inverse[begin]
    return Tokens(mix(hashes), doc_start, begin, end, data)


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case by Unicode's simple mapping."""
    return pc.utf8_lower(texts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k tokens; position i holds the run that starts at i (len - k + 1 of them, across texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = hashes[:n].copy()
        for j in range(1, k):
            h *= U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(32)
            h += hashes[j : j + n]
    return mix(h)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(tokenise(raw, np.array([0, len(raw)])).hashes[0])


class HashIndex:
    """Open-addressing table of distinct uint64 keys, looked up for a whole array at once; gives the key's rank in ``keys`` or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(U64)
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift = U64(64 - bits)
        self.mask = (1 << bits) - 1
        self.slot_key = np.zeros(1 << bits, U64)
        self.slot = np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(self.keys), dtype=np.int32), self._home(self.keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several for one slot the last wins
            won = self.slot[at] == todo
            self.slot_key[at[won]] = self.keys[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask
        self.filled = self.slot >= 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.slot[at]
        miss = np.flatnonzero((out >= 0) & (self.slot_key[at] != keys))
        while len(miss):
            at[miss] = (at[miss] + 1) & self.mask
            got = self.slot[at[miss]]
            out[miss] = got
            miss = miss[(got >= 0) & (self.slot_key[at[miss]] != keys[miss])]
        return out


def atomic_save(path: str, array: np.ndarray) -> None:
    """Writes an array so that a repeated or speculative task leaves a whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as out:
        np.save(out, array, allow_pickle=False)
    os.replace(tmp, path)
