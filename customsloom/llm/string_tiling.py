"""Benchmark decontamination by greedy string tiling.

Texts and test items are lower-cased words (runs of letters, digits and non-ASCII characters).  Fingerprints of all windows of
``min_match`` words (Karp-Rabin, for a whole batch at once) are joined with those of the items.  The longest match of a text and
an item becomes a tile, its words are marked on both sides, and this goes on among unmarked words until no match of
``min_match`` words is left.  The tiles' share of an item's words is its coverage: passages count in whatever order they stand.
Only pairs whose windows could reach the threshold at all are tiled; that bound is exact, so nothing is lost.  Tiles count if
their words are the same byte by byte.

The distinct items are taken in blocks of at most about ``block_bytes`` of text, each broadcast in turn; documents are never
shuffled, and what is found is joined with the ids of equal items.

Defined cases.  Null and empty texts match nothing, nor do items without words.  An item of two to ``min_match`` - 1
words is matched where they stand in a row, one of a single word where it is a whole line of a text (the word alone would be met in clean texts).  Of equally long matches the first in
the item, then in the text, goes first.  Repeated rows and items are judged one by one; a null id is carried through.  Texts and
items that repeat words take time in proportion to their words, for each length of a tile.  Other columns of the inputs are
ignored by ``matches`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from customsloom.llm.common import U64, HashIndex, Tokens, blocks, grams, lowered, tokenise

MIN_MATCH = 5
MIN_COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
#: Least words of an item that is found within a line.
ANYWHERE = 2


class Items:
    """Words of the test items and fingerprints of their windows."""

    def __init__(self, keys: list[str], texts: pa.Array, min_match: int):
        self.keys, self.m = keys, min_match
        hashes, lengths, begin, end, raw, size = [], [], [], [], [], 0
        for _, data, offsets in blocks(lowered(texts.cast(pa.large_string()))):
            t = tokenise(data, offsets, words_only=True)
            hashes.append(t.hashes)
            lengths.append(np.diff(t.doc_start))
            begin.append(t.begin + size)
            end.append(t.end + size)
            raw.append(t.data)
            size += len(t.data)
        self.hashes, self.begin, self.end, self.raw = (np.concatenate(x) for x in (hashes, begin, end, raw))
        self.length = np.concatenate(lengths)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        window, item, at = windows(self.hashes, self.start, min_match)
        order = np.lexsort((at, item, window))
        window, self.item, self.at = window[order], item[order], at[order]
        keys_, first = np.unique(window, return_index=True)
        self.index = HashIndex(keys_)
        self.first = np.append(first, len(window))
        # items of fewer words are looked up whole, by their number of words
        self.short: dict[int, tuple[HashIndex, np.ndarray]] = {}
        for n in range(1, min_match):
            own = np.flatnonzero(self.length == n)
            if len(own):
                found, at = np.unique(grams(self.hashes, n)[self.start[own]], return_index=True)
                self.short[n] = (HashIndex(found), own[at])

    def words(self, item: int) -> np.ndarray:
        return self.hashes[self.start[item] : self.start[item + 1]]

    def spelt(self, item: int, at: int, n: int) -> list[bytes]:
        lo = self.start[item] + at
        return [self.raw[b:e].tobytes() for b, e in zip(self.begin[lo : lo + n], self.end[lo : lo + n], strict=True)]


def windows(hashes: np.ndarray, start: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, position in the text) of each window that lies in one text."""
    window = grams(hashes, m)
    text = np.repeat(np.arange(len(start) - 1), np.diff(start))[: len(window)]
    at = np.arange(len(window)) - start[text] if len(window) else np.zeros(0, np.int64)
    inside = at + m <= np.diff(start)[text] if len(window) else np.zeros(0, bool)
    return window[inside], text[inside], at[inside]


def tile(item: np.ndarray, text: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the text, words) of at least m words of two sequences of word hashes.

    All longest matches go first, in the order of the item, then the text; their length is searched among prefix hashes of all
    unmarked windows (Karp-Rabin), so that no table of pairs of places is made: time and memory grow with the words, for each
    length of a tile.  Windows that meet are compared word by word.
    """
    sides = [_Side(item), _Side(text)]
    tiles, upper = [], min(len(item), len(text))
    while upper >= m:
        lo, hi = m - 1, upper  # the longest match is of lo to hi words
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(_common(sides, mid)) else (lo, mid - 1)
        if lo < m:
            break
        tiles += _tiles_of(sides, lo)
        upper = lo - 1
    return tiles


_BASE = 0xF1357AEA2E62A9C5
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Side:
    """A sequence of words with prefix hashes and the words marked so far."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(max(0, n - 1), _BASE, U64)]))[:n]
            self.inverse = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(max(0, n - 1), _INVERSE, U64)]))[:n]
            self.sums = np.concatenate([[U64(0)], np.cumsum(words * power)])
        self.marked = np.zeros(n, bool)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of all windows of unmarked words."""
        at = np.arange(max(0, len(self.words) - size + 1))
        if self.marked.any():
            seen = np.concatenate([[0], np.cumsum(self.marked)])
            at = at[seen[at + size] == seen[at]]
        with np.errstate(over="ignore"):
            return (self.sums[at + size] - self.sums[at]) * self.inverse[at], at


def _common(sides: list[_Side], size: int) -> np.ndarray:
    return np.intersect1d(sides[0].windows(size)[0], sides[1].windows(size)[0])


def _tiles_of(sides: list[_Side], size: int) -> list[tuple[int, int, int]]:
    """Marks and gives all tiles of one size, the longest there is."""
    a, b = sides
    (own, at), (other, place) = a.windows(size), b.windows(size)
    order = np.argsort(other, kind="stable")
    other, place = other[order], place[order]
    lo, hi = np.searchsorted(other, own), np.searchsorted(other, own, side="right")
    next_of: dict[int, int] = {}  # of equal windows of the text those before are marked
    out, end = [], -1
    for k in np.flatnonzero(hi > lo).tolist():
        i = int(at[k])
        if i < end:
            continue
        first = int(lo[k])
        j = next_of.get(first, first)
        while j < hi[k]:
            q = int(place[j])
            if b.marked[q] or b.marked[q + size - 1]:  # marked runs are of at least this size: they hold an end of what they meet
                j += 1
                continue
            if np.array_equal(a.words[i : i + size], b.words[q : q + size]):
                a.marked[i : i + size] = b.marked[q : q + size] = True
                out.append((i, q, size))
                end = i + size
                j += 1
                break
            j += 1
        next_of[first] = j
    return out


def covered(texts: pa.Array, items: Items, least: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, words of the item in tiles, tiles) of the pairs that reach ``least``."""
    for row, data, offsets in blocks(lowered(texts.cast(pa.large_string()))):
        t = tokenise(data, offsets, words_only=True)
        for text, item in _entire(t, items):
            yield row + text, item, int(items.length[item]), 1
        window, text, _ = windows(t.hashes, t.doc_start, items.m)
        key = items.index.find(window)
        hit = key >= 0
        if not hit.any():
            continue
        met = np.unique(text[hit] * len(items.first) + key[hit])  # each window of the items once a text
        text, key = met // len(items.first), met % len(items.first)
        first, n = items.first[key], items.first[key + 1] - items.first[key]
        place = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        text, item, i = np.repeat(text, n), items.item[place], items.at[place]
        order = np.lexsort((i, item, text))
        text, item, i = text[order], item[order], i[order]
        # words of the item in windows that the text has: no tiles cover more
        group = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(item) != 0)]))
        step = np.minimum(np.diff(i, append=0), items.m)
        step[np.append(group[1:], len(i)) - 1] = items.m
        most = np.add.reduceat(step, group)
        for a in group[most >= least * items.length[item[group]]].tolist():
            r, k = int(text[a]), int(item[a])
            lo, hi = t.doc_start[r], t.doc_start[r + 1]
            tiles = tile(items.words(k), t.hashes[lo:hi], items.m)
            tiles = [x for x in tiles if items.spelt(k, x[0], x[2]) == [t.data[b:e].tobytes() for b, e in zip(t.begin[lo + x[1] : lo + x[1] + x[2]], t.end[lo + x[1] : lo + x[1] + x[2]], strict=True)]]
            if (total := sum(x[2] for x in tiles)) >= least * items.length[k]:
                yield row + r, k, total, len(tiles)


def _entire(t: Tokens, items: Items) -> Iterator[tuple[int, int]]:
    """(text, item) of the items of fewer than min_match words that the text holds: their words in a row, or a whole line that is the item's one word."""
    if not items.short or not len(t.hashes):
        return
    line = np.cumsum(t.data == 10)[t.begin]
    new = np.concatenate([[True], np.diff(line) != 0])
    new[t.doc_start[:-1][t.doc_start[:-1] < len(new)]] = True
    for n, (index, item) in items.short.items():
        window, text, at = windows(t.hashes, t.doc_start, n)
        key = index.find(window)
        hit = key >= 0
        if n < ANYWHERE:
            hit &= new & np.append(new[1:], True)  # windows of one word are the words
        text, key, at = text[hit], key[hit], (t.doc_start[text] + at)[hit]
        met, first = np.unique(text * len(item) + key, return_index=True)
        for k, place in zip(met.tolist(), at[first].tolist(), strict=True):
            own = int(item[k % len(item)])
            if items.spelt(own, 0, n) == [t.data[b:e].tobytes() for b, e in zip(t.begin[place : place + n], t.end[place : place + n], strict=True)]:
                yield k // len(item), own


def _keyed(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key) of the items that aren't empty; equal texts have one key."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") > 0)
    return rows.withColumn("key", F.sha2("text", 256))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, block_bytes: int) -> Iterator[Items]:
    """The distinct items, in blocks of a size that can be broadcast: about block_bytes, or the longest item where that is more."""
    rows = _keyed(benchmark, id_col, text_col).groupBy("key").agg(F.first("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).orderBy("key").toArrow()
        if len(part):
            yield Items(part.column("key").to_pylist(), part.column("text").combine_chunks(), min_match)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per contaminated document and item: ids, coverage, words of the item in tiles, its words, tiles."""
    kind, item_kind = dict(docs.select(id_col).dtypes)[id_col], dict(benchmark.select(item_col).dtypes)[item_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded, see item_blocks

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                if got := list(covered(b.column(1), items, min_coverage)):
                    row, item, total, tiles = zip(*got, strict=True)
                    words = [int(items.length[k]) for k in item]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row, pa.int64())), pa.array([items.keys[k] for k in item]), pa.array([n / w for n, w in zip(total, words, strict=True)]), pa.array(total, pa.int64()), pa.array(words, pa.int64()), pa.array(tiles, pa.int32())],
                        ["id", "key", "coverage", "covered_words", "item_words", "tiles"],
                    )

        part = rows.mapInArrow(found, f"id {kind}, key string, coverage double, covered_words bigint, item_words bigint, tiles int")
        out = part if out is None else out.unionAll(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {item_col} {item_kind}, coverage double, covered_words bigint, item_words bigint, tiles int")
    ids = _keyed(benchmark, item_col, item_text_col).select("key", F.col("id").alias("item"))
    out = out.join(ids, "key").select("id", "item", "coverage", "covered_words", "item_words", "tiles")
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text covers no test item."""
    at = docs.columns.index(text_col)
    for items in item_blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # bounded, see item_blocks

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in covered(b.column(at), shared.value, min_coverage)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
