"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics.

Each language has a tree of byte contexts of orders 0 to ``order``.  A byte's code length is that of PPM method C with symbol
exclusion: in the longest context that was seen, a seen byte of count c costs -log2(c / (T + q)) and an escape
-log2(q / (T + q)), with T the context's total and q its number of distinct bytes; after an escape, bytes of the longer context
are excluded from the shorter one's T and q; bytes never seen share the rest evenly.  The statistics don't change while a text
is scored, so a byte's cost depends on it and the ``order`` bytes before it alone, and the costs of every run of order + 1
bytes seen in training are worked out once, per language, into one hash table.  Runs that aren't in it are worked out where
they turn up.  The language of the shortest code wins; the score is its posterior under equal priors.

Learning takes at most about ``sample_docs`` labelled texts or ``sample_bytes`` bytes a language (those with the smallest hash of
their id), a bounded sample, so that the table that workers get stays bounded; whole texts are used.  Counts are made and summed
in Spark.

Defined cases.  A null text, one without any letter, and any text when nothing could be learned: ``und``, score 0.  Ties go to
the language that sorts first.  Rows with null or empty text or null language teach nothing.  Repeated rows count each time.
A null id is never held out.  Other columns of the input are ignored.  ``keep_identified`` keeps every text with a letter where
nothing could be learned: there is nothing to reject by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from customsloom.llm.common import U64, HashIndex, blocks
from customsloom.llm.kneser_ney import fold

ORDER = 3
SAMPLE_DOCS = 1_500
#: Bytes of text of a language that are learned from, about.
SAMPLE_BYTES = 32 << 20
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PAD = 0x20


def contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it in its text (spaces before the first), the byte itself lowest."""
    keys = data.astype(U64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    ends = offsets[1:][np.diff(offsets) > 0]
    for j in range(1, order + 1):
        before = np.empty(len(data), U64)
        before[j:] = data[: len(data) - j]
        for r in range(min(j, len(data))):
            at = starts + r
            before[at[at < ends]] = _PAD
        keys |= before << U64(8 * j)
    return keys


@dataclass
class Tree:
    """One language's statistics by order: sorted contexts with total and distinct bytes, and sorted (context, byte) with counts."""

    context: list[np.ndarray]
    total: list[np.ndarray]
    distinct: list[np.ndarray]
    pair: list[np.ndarray]
    count: list[np.ndarray]
    shadow: list[np.ndarray]  # per context of order j: what its bytes count for in the context one byte shorter

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> Tree:
        """From the counts of distinct runs of order + 1 bytes."""
        out = cls([], [], [], [], [], [])
        for j in range(order + 1):
            pair, inverse = np.unique(keys & U64((1 << 8 * (j + 1)) - 1), return_inverse=True)
            count = np.bincount(inverse, counts, len(pair))
            context, first = np.unique(pair >> U64(8), return_index=True)
            out.context.append(context)
            out.total.append(np.add.reduceat(count, first) if len(first) else count)
            out.distinct.append(np.diff(np.append(first, len(pair))).astype(float))
            shadow = np.zeros(len(context))
            if j and len(pair):
                shorter = np.searchsorted(out.pair[j - 1], pair & U64((1 << 8 * j) - 1))
                shadow = np.add.reduceat(out.count[j - 1][shorter], first)
            out.pair.append(pair)
            out.count.append(count)
            out.shadow.append(shadow)
        return out

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Exact code length of each run's last byte after the bytes before it."""
        order = len(self.context) - 1
        cost, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        above_total, above_distinct = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(order, -1, -1):
            context = (keys >> U64(8)) & U64((1 << 8 * j) - 1)
            at, there = _find(self.context[j], context)
            use = open_ & there
            total = np.where(use, self.total[j][at], 0) - above_total
            distinct = np.where(use, self.distinct[j][at], 0) - above_distinct
            pair_at, seen = _find(self.pair[j], keys & U64((1 << 8 * (j + 1)) - 1))
            hit = use & seen
            some = use & (total + distinct > 0)
            room = np.where(some, total + distinct, 1.0)
            cost += np.where(hit, -np.log2(np.where(hit, self.count[j][pair_at], 1) / room), 0)
            escape = some & ~seen
            cost += np.where(escape, -np.log2(np.where(escape, distinct, 1) / room), 0)
            open_ &= ~hit
            above_total = np.where(open_ & there, self.shadow[j][at], 0)
            above_distinct = np.where(open_ & there, self.distinct[j][at], 0)
        cost[open_] += np.log2(256 - self.distinct[0][0])
        return cost


def _find(stored: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(stored, keys), len(stored) - 1)
    return at, stored[at] == keys


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    order: int
    index: HashIndex
    cost: np.ndarray  # float32: run, language

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
        langs = sorted(counts)
        trees = [Tree.of(*counts[x], order) for x in langs]
        runs = np.unique(np.concatenate([counts[x][0] for x in langs])) if langs else np.zeros(0, U64)
        return cls(langs, trees, order, HashIndex(runs), np.stack([t.bits(runs) for t in trees], 1).astype(np.float32) if langs else np.zeros((0, 0), np.float32))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text of a block under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full) or not self.langs:
            return out
        keys = contexts(data, offsets, self.order)
        at = self.index.find(keys)
        cost = self.cost[at]
        if len(new := np.flatnonzero(at < 0)):
            runs, inverse = np.unique(keys[new], return_inverse=True)
            cost[new] = np.stack([t.bits(runs) for t in self.trees], 1)[inverse]
        for i in range(len(self.langs)):
            out[full, i] = np.add.reduceat(cost[:, i], offsets[:-1][full], dtype=np.float64)
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from about ``sample_docs`` rows and ``sample_bytes`` bytes of each language, or all if there are fewer."""
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    rows = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(F.col(text_col)) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    have = {r["lang"]: max(r["n"] / sample_docs, r["size"] / sample_bytes) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if not have:
        return Model.of({}, order)
    share = F.create_map(*[F.lit(x) for lang, over in sorted(have.items()) for x in (lang, min(1.0, 1 / over))])
    picked = rows.where((F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.asarray(b.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                parts = [contexts(d, o, order) for _, d, o in blocks(b.column(1).filter(pa.array(langs == lang)))]
                runs, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(runs.view(np.int64)), pa.array(n, pa.int64())], ["lang", "run", "n"])

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, run bigint, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    langs = np.asarray(counted.column("lang").to_pylist(), dtype=object)
    runs, n = counted.column("run").to_numpy().view(U64), counted.column("n").to_numpy().astype(float)
    out = {}
    for lang in sorted(set(langs)):
        own = langs == lang
        order_of = np.argsort(runs[own])
        out[lang] = (runs[own][order_of], n[own][order_of])
    return Model.of(out, order)


def _lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (posterior), bits_per_byte (of the chosen language; null for und)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, "und"], dtype=object)
        for b in batches:
            lang, score, rate = [], [], []
            for _, data, offsets in blocks(b.column(1)):
                bits = model.code_lengths(data, offsets)
                if not model.langs:
                    best, sure, least = np.zeros(len(bits), int), np.zeros(len(bits)), np.zeros(len(bits))
                else:
                    best = bits.argmin(1)
                    least = bits[np.arange(len(bits)), best]
                    sure = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                ok = _lettered(data, offsets) & bool(model.langs)
                lang.append(np.where(ok, best, len(model.langs)))
                score.append(np.where(ok, sure, 0.0))
                rate.append(np.where(ok, least / np.maximum(np.diff(offsets), 1), np.nan))
            if lang:
                rate = np.concatenate(rate)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[np.concatenate(lang)], pa.string()), pa.array(np.concatenate(score)), pa.array(rate, mask=np.isnan(rate))], ["id", "lang_pred", "score", "bits_per_byte"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predicted, f"id {kind}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of at least ``least_score``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [np.zeros(0, bool)]
            for _, data, offsets in blocks(b.column(at)):
                bits = shared.value.code_lengths(data, offsets)
                sure = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True, initial=np.inf) - bits, -1000)).sum(1) if bits.shape[1] else None
                keep.append(_lettered(data, offsets) & ((sure >= least_score) if bits.shape[1] else True))
            yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(kept, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """The language of every document, under a model of those whose fold of 4 is not 2."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    out = predict(docs, fit(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")
