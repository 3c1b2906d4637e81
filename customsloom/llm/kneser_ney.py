"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

Storage.  The vocabulary is one sorted array of 64-bit word hashes, cut into shards by hash range; a word's id is its rank.
Seen word pairs are sorted arrays of a bijective 64-bit mix of (context id, word id), cut into shards the same way, beside
their counts.  Per word id the shards also hold count, context total, the numbers of successors seen once, twice and more
often, and the number of distinct predecessors.  Shards are ``.npy`` files in the shared folder; workers map them and look
up sorted, distinct keys of a block of texts, so that pages of a file are touched in order and shared between workers.

Counting.  A task turns its texts into sorted arrays of distinct words or pairs with counts (a map-side combine), cuts them
by hash range and hands each range over as one packed row.  A word or pair is therefore in a shuffle once per task and block,
however frequent it is; pairs are dealt by the hash of both words, so that a frequent context spreads over all shards.

Order.  Two: a third level would shuffle and keep about three times as much (see README for figures).  The number of distinct
words must stay below 2**32 - 1; more raises an error.

Defined cases.  A null text is empty; an empty text has one token, its end.  Repeated rows count each time.  Without training
texts each probability is 1 / (V + 1) = 1.  A null id is never held out.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import mmap
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from customsloom.llm.common import U64, atomic_save, blocks, mix, mounted, new_folder, tokenise, word_hash

#: Stands for the end of a text; contains a space, so it is no word.
END = U64(0x5D1F3A9C0E6B2741)
#: Tokens gathered before they are combined: bounds a counting task's memory.
COMBINE = 2_000_000
#: Text bytes that a pair shard stands for.
SHARD_BYTES = 24 << 20
#: Power of the number of pair shards that gives the number of vocabulary shards: a vocabulary grows more slowly than its text,
#: and every pair shard hands each vocabulary shard a row.
WORD_SHARDS = 0.75
#: Arrays that a worker keeps mapped, without a file handle each where Python can do that.
_MAPPING = {"trackfd": False} if sys.version_info >= (3, 13) else {}
MOST_MAPS = 16_384 if _MAPPING else 256


@dataclass
class Model:
    """Where a fitted model lies, with its few global numbers."""

    path: str
    starts: list[int]  # first id of each vocabulary shard, then the number of words
    pair_shards: int
    tokens: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_backoff: float
    end_id: int
    maps: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "bounds"} | {"maps": {}}

    @property
    def words(self) -> int:
        return self.starts[-1]

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.array(self.starts)

    def array(self, name: str, shard: int) -> np.ndarray:
        """A stored array, memory-mapped; of more than MOST_MAPS the one mapped first goes."""
        found = self.maps.get((name, shard))
        if found is None:
            while len(self.maps) >= MOST_MAPS:
                self.maps.pop(next(iter(self.maps)))
            found = self.maps[name, shard] = _mapped(f"{self.path}/{name}-{shard}.npy")
        return found

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct word hashes, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        for shard, a, b in _cuts(hashes, len(self.starts) - 1):
            if self.starts[shard + 1] > self.starts[shard]:
                keys = self.array("word", shard)
                at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
                out[a:b] = np.where(keys[at] == hashes[a:b], at + self.starts[shard], -1)
        return out

    def stats(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A per-word number for sorted ids; 0 for -1."""
        out = np.zeros(len(ids), np.float64)
        known = int(np.searchsorted(ids, 0)), int(np.searchsorted(ids, self.words))
        for shard, a, b in _runs(np.searchsorted(self.bounds, ids[known[0] : known[1]], side="right") - 1):
            a, b = a + known[0], b + known[0]
            out[a:b] = self.array(name, shard)[ids[a:b] - self.starts[shard]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct mixed pair keys."""
        out = np.zeros(len(keys), np.float64)
        for shard, a, b in _cuts(keys, self.pair_shards):
            if len(stored := self.array("pair", shard)):
                at = np.minimum(np.searchsorted(stored, keys[a:b]), len(stored) - 1)
                out[a:b] = np.where(stored[at] == keys[a:b], self.array("pair_count", shard)[at], 0)
        return out


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Hash ranges of equal width, so that shards in order are one sorted array."""
    return ((hashes >> U64(32)) * U64(shards)) >> U64(32)


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of equal values: only shards that occur take time."""
    if not len(shard):
        return
    first = np.flatnonzero(np.diff(shard, prepend=shard[:1] + 1))
    yield from zip(shard[first].tolist(), first.tolist(), np.append(first[1:], len(shard)).tolist(), strict=True)


def _cuts(hashes: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted hashes."""
    return _runs(_shard_of(hashes, shards).astype(np.int64))


def _mapped(path: str) -> np.ndarray:
    with open(path, "rb") as file:
        np.lib.format.read_magic(file)
        shape, _, kind = np.lib.format.read_array_header_1_0(file)
        if not shape[0]:
            return np.zeros(0, kind)
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **_MAPPING), kind, shape[0], file.tell())


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length with their kinds, as bytes."""
    kinds = "".join(a.dtype.char for a in arrays).encode()
    return bytes([len(kinds)]) + kinds + b"".join(a.tobytes() for a in arrays)


def _unpack(raw: bytes) -> list[np.ndarray]:
    kinds = [np.dtype(chr(c)) for c in raw[1 : 1 + raw[0]]]
    at, n = 1 + raw[0], (len(raw) - 1 - raw[0]) // sum(k.itemsize for k in kinds)
    out = []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * k.itemsize
    return out


def _summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(w[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for w in weights)


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "packed"])


def _sequences(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes with END after each text, start of each text in them) per block."""
    for _, data, offsets in blocks(texts):
        t = tokenise(data, offsets)
        yield np.insert(t.hashes, t.doc_start[1:], END), t.doc_start + np.arange(len(t.doc_start))


def _id_sequences(texts: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sorted ids of the block's distinct words, index of each token in them, contexts, starts); a text's first context is the id V."""
    for hashes, starts in _sequences(texts):
        distinct, inverse = np.unique(hashes, return_inverse=True)
        ids = model.ids(distinct)  # ids rise with the hash, but for the unknown
        token = ids[inverse]
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[starts[:-1]] = model.words
        yield token, context, starts, hashes


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((context.astype(U64) << U64(32)) | word.astype(U64))


def _unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    h = h ^ (h >> U64(31)) ^ (h >> U64(62))
    h = h * U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = h ^ (h >> U64(27)) ^ (h >> U64(54))
    h = h * U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> U64(30)) ^ (h >> U64(60))


def _combined(parts: Iterator[np.ndarray], shards: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        keys = np.concatenate(held)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        rows = []
        for shard, a, b in _cuts(keys, shards):
            if pairs:  # in the order of the context, as differences, which a shuffle compresses well
                raw = _unmix(keys[a:b])
                order = np.argsort(raw)
                raw = raw[order]
                context = (raw >> U64(32)).astype(np.uint32)
                rows.append((shard, _pack(np.diff(context, prepend=np.uint32(0)), raw.astype(np.uint32), _wide(counts[a:b][order]))))
            else:
                rows.append((shard, _pack(keys[a:b], _wide(counts[a:b]))))
        return _rows(rows)

    for p in parts:
        held.append(p)
        n += len(p)
        if n >= COMBINE:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _wide(counts: np.ndarray) -> np.ndarray:
    return _narrow(counts)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of events seen 1, 2, 3 and 4 times; fixed ones where a number is 0."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.0), float(i + 1)) for i, x in enumerate(d))  # type: ignore[return-value]


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def fit(texts: DataFrame, text_col: str = "text") -> Model:
    """Counts a model over all rows of ``texts``."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    path = mounted(new_folder(spark, "kneser-ney"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    word_shards = math.ceil(shards**WORD_SHARDS)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined((h for b in batches for h, _ in _sequences(b.column(0))), word_shards, False)

    def store_words(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [_unpack(p) for p in group.column("packed").to_pylist()]
        keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        atomic_save(f"{path}/word-{shard}.npy", keys)
        atomic_save(f"{path}/count-{shard}.npy", _narrow(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64())})

    os.makedirs(path, exist_ok=True)
    packed = texts.mapInArrow(count_words, "shard int, packed binary")
    stored = _by_shard(packed, word_shards).groupBy("shard").applyInArrow(store_words, "shard int, n bigint, total bigint").collect()
    sizes = [0] * word_shards
    for r in stored:
        sizes[r["shard"]] = r["n"]
    starts = [0, *np.cumsum(sizes).tolist()]
    if starts[-1] >= (1 << 32) - 1:
        raise ValueError(f"{starts[-1]} distinct words; ids have 32 bits")
    model = Model(path, starts, shards, sum(r["total"] for r in stored), 0, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 1.0, -1)
    if not stored:
        return model
    model.end_id = int(model.ids(np.array([END]))[0])
    bounds = np.array(starts)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined((_pair_key(c, t) for b in batches for t, c, _, _ in _id_sequences(b.column(0), model)), shards, True)

    def store_pairs(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [_unpack(p) for p in group.column("packed").to_pylist()]
        raw = np.concatenate([(np.cumsum(p[0], dtype=np.uint32).astype(U64) << U64(32)) | p[1].astype(U64) for p in parts])
        keys, counts = _summed(mix(raw), np.concatenate([p[2].astype(np.int64) for p in parts]))
        del raw, parts
        atomic_save(f"{path}/pair-{shard}.npy", keys)
        atomic_save(f"{path}/pair_count-{shard}.npy", _narrow(counts))
        raw = _unmix(keys)
        rows = [(-1, _pack(np.array([*_of_counts(counts), len(counts)], np.int64)))]
        context = (raw >> U64(32)).astype(np.int64)
        sums = _summed(context, counts, counts == 1, counts == 2, counts > 2)
        inside = sums[0] < model.words  # the start of a text is no word; its numbers go with the shard -2
        rows.append((-2, _pack(*(s[~inside] for s in sums))))
        rows += _dealt([s[inside] for s in sums], bounds)
        rows += _dealt(list(_summed((raw & U64(0xFFFFFFFF)).astype(np.int64), np.ones(len(raw), np.int64))), bounds)
        batch = _rows(rows)
        return pa.Table.from_batches([batch])

    def store_stats(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = [_unpack(p) for p in group.column("packed").to_pylist()]
        if shard == -1:
            seen = np.sum([p[0] for p in parts], axis=0).tolist()
        elif shard == -2:
            start = np.sum([[int(x.sum()) for x in p[1:]] for p in parts], axis=0)
            for i, name in enumerate(("total", "once", "twice", "more")):
                atomic_save(f"{path}/{name}-{len(starts) - 1}.npy", np.array([start[i]], np.uint64))
            seen = [0] * 5
        else:
            n = starts[shard + 1] - starts[shard]
            columns = np.zeros((5, n), np.int64)
            for p in parts:
                ids = p[0].astype(np.int64)
                if len(p) == 2:
                    columns[4][ids] += p[1]
                else:
                    for i in range(4):
                        columns[i][ids] += p[1 + i]
            for i, name in enumerate(("total", "once", "twice", "more", "before")):
                atomic_save(f"{path}/{name}-{shard}.npy", _narrow(columns[i]))
            seen = [*_of_counts(columns[4]), int((columns[4] > 2).sum())]
        return pa.table({"shard": pa.array([shard], pa.int32()), "seen": pa.array([seen], pa.list_(pa.int64()))})

    pairs = _by_shard(texts.mapInArrow(count_pairs, "shard int, packed binary"), shards).groupBy("shard").applyInArrow(store_pairs, "shard int, packed binary")
    stats = _by_shard(pairs, word_shards + 2).groupBy("shard").applyInArrow(store_stats, "shard int, seen array<bigint>").collect()
    of_pairs = next(r["seen"] for r in stats if r["shard"] == -1)
    of_words = np.sum([r["seen"] for r in stats if r["shard"] >= 0], axis=0)
    model.pairs = of_pairs[4]
    model.pair_discounts = _discounts(of_pairs[:4])
    model.word_discounts = d = _discounts(of_words[:4])
    model.word_backoff = float(d[0] * of_words[0] + d[1] * of_words[1] + d[2] * of_words[4]) / model.pairs
    return model


def _by_shard(packed: DataFrame, n: int) -> DataFrame:
    """Each of n shards in a task of its own: dealt by the shard's number, as by its hash a few would share a task."""
    return packed.repartitionById(n, F.col("shard")) if hasattr(packed, "repartitionById") else packed.repartition(n, "shard")


def _dealt(columns: list[np.ndarray], bounds: np.ndarray) -> list[tuple[int, bytes]]:
    """Sorted ids with numbers, cut by vocabulary shard; ids count from the shard's first."""
    edges = np.searchsorted(columns[0], bounds)
    return [
        (s, _pack(_narrow(columns[0][a:b] - bounds[s]), *(_narrow(c[a:b]) for c in columns[1:])))
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
        if b > a
    ]


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)], 0.0)


def log_probabilities(model: Model, token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of each token id after its context id; -1 is an unknown word, V the start of a text."""
    words, at = np.unique(token, return_inverse=True)
    count, before = model.stats("count", words), model.stats("before", words)
    uniform = 1.0 / (model.words + 1)
    low = (_discount(before, model.word_discounts) / model.pairs + model.word_backoff * uniform) if model.pairs else np.full(len(words), uniform)
    low, count = low[at], count[at]
    if not model.pairs:
        return np.log10(low), count
    contexts, at = np.unique(context, return_inverse=True)
    n = [model.stats(name, contexts) for name in ("total", "once", "twice", "more")]
    if len(contexts) and contexts[-1] == model.words:
        for x, name in zip(n, ("total", "once", "twice", "more"), strict=True):
            x[-1] = float(model.array(name, len(model.starts) - 1)[0])
    total = n[0][at]
    seen = total > 0
    d = model.pair_discounts
    left = ((d[0] * n[1] + d[1] * n[2] + d[2] * n[3]) / np.maximum(n[0], 1))[at]
    both = np.flatnonzero(seen & (token >= 0))
    pair = np.zeros(len(token))
    keys, back = np.unique(_pair_key(context[both], token[both]), return_inverse=True)
    pair[both] = model.pair_counts(keys)[back]
    p = np.where(seen, _discount(pair, d) / np.maximum(total, 1) + left * low, low)
    return np.log10(p), count


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (Kneser-Ney), perplexity."""
    base = math.log10(model.tokens + model.words + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, known, plain, kn = [], [], [], []
            for token, context, starts, _ in _id_sequences(b.column(1), model):
                logs, count = log_probabilities(model, token, context)
                at = starts[:-1]  # each text has its end at least
                n.append(np.diff(starts))
                known.append(np.add.reduceat((count > 0).astype(np.int64), at))
                plain.append(np.add.reduceat(np.log10(count + 1) - base, at))
                kn.append(np.add.reduceat(logs, at))
            if n:
                n, known, plain, kn = (np.concatenate(x) for x in (n, known, plain, kn))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(plain), pa.array(kn), pa.array(10 ** (-kn / n))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(scored, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
    return out.withColumnRenamed("id", id_col)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def score_documents(docs: DataFrame) -> DataFrame:
    """All texts, under a model of those whose fold of 7 is not 2."""
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model = fit(docs.where(~held))
    out = score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


__all__ = ["END", "Model", "fit", "fold", "log_probabilities", "score", "score_documents", "word_hash"]
