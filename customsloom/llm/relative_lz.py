"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against the phrases of every reference block.

The corpus is its own reference.  Each block of texts is cut into phrases at places that depend on nothing but the words: of the
``ANCHOR``-word sequences of a window of ``window`` words the one of least hash is its anchor, and a phrase is a run of windows of one
anchor.  The index of a block is the table of its phrases: anchor, contents, document.  The indexes of all blocks are one table, and a
document is factored against all of them at once, by grouping and joining on anchor and contents instead of a search per pair.

A document is parsed from left to right: a phrase that occurs elsewhere whole is copied, and the factor goes on as long as
phrases are.  At a factor's boundary stand phrases of which other documents hold a part: those that share their anchor but not
their contents.  There every window is checked by itself against the windows of all phrases of the anchor (of equal phrases
one stands for all).  Windows found elsewhere join the factors beside them, and a factor is a duplicate span as it holds a whole window.
Equal windows have equal anchors, so none is missed; keys are 128 bits (anchor and contents).

Texts aren't shuffled (``blockwise``).  A phrase, however frequent, leaves each task once in the grouping; the joins have one
row a key on one side.

Defined cases.  A null text has no words; texts shorter than a window lose nothing.  Every row is a document of its own: repeated
rows of at least ``window`` words are removed from each other, under any id, null ids too.  Overlapping windows of one text
count as occurrences.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from customsloom.llm.blockwise import Answers, answer, by_block, number
from customsloom.llm.common import Tokens, U64, blocks, discard, mix, tokenise, written

WINDOW = 35
#: Words of an anchor: a phrase has about (window - ANCHOR + 2) / 2 windows.
ANCHOR = 8
_STEP, _BACK = 0xC2B2AE3D27D4EB4F, pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64)


class Sequence:
    """Hashes of any run of words of a block in constant time, from running sums of the words' hashes times powers."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _STEP, U64)
            back = np.full(n + 1, _BACK, U64)
            power[0] = back[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(back, out=back)
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(hashes * power[:n], out=self.sums[1:])
        self.back = back

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + U64(1) * np.asarray(length).astype(U64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each run of ``width`` values, the last one of equals."""
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] <= values[left], right, left)
        have += step
    return at


def phrases(t: Tokens, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in it, windows, anchor, contents) of every phrase of a block of texts."""
    none = np.zeros(0, np.int64)
    k = min(ANCHOR, window)
    if len(t.hashes) < window:
        return none, none, none, none, none
    sequence = Sequence(t.hashes)
    gram = sequence.of(np.arange(len(t.hashes) - k + 1), k)
    least = _least(gram, window - k + 1)
    doc = t.doc_of
    inside = np.flatnonzero(doc[: len(least)] == doc[window - 1 :])  # windows that lie in one text
    if not len(inside):
        return none, none, none, none, none
    new = np.concatenate([[True], (np.diff(inside) != 1) | (np.diff(least[inside]) != 0) | (np.diff(doc[inside]) != 0)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(inside)))
    start = inside[first]
    text = doc[start]
    return text, start - t.doc_start[text], count, gram[least[start]].view(np.int64), sequence.of(start, count + window - 1).view(np.int64)


def _words(rows: pa.RecordBatch) -> Iterator[tuple[int, Tokens]]:
    for first, data, offsets in blocks(rows.column(rows.num_columns - 1)):
        yield first, tokenise(data, offsets, lower=False)


def _parsed(texts: DataFrame, window: int) -> DataFrame:
    """(uid, start, n, anchor, contents): the phrases of every text, which are the index of its block as well."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, t in _words(b):
                text, start, count, anchor, contents = phrases(t, window)
                if len(text):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text + first)), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(anchor), pa.array(contents)], ["uid", "start", "n", "anchor", "contents"])

    return texts.select("uid", "text").mapInArrow(parsed, "uid bigint, start int, n int, anchor bigint, contents bigint")


def _boundary_windows(texts: DataFrame, folder: str, window: int) -> DataFrame:
    """(uid, at, anchor, contents, weight) of every window of the phrases that are to be checked window by window."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folder)
        for b in batches:
            for block, rows in by_block(b):
                found = answers.of(block)
                if found is None:
                    continue
                uid = rows.column(0).to_numpy()
                where = np.searchsorted(uid, found.column("uid").to_numpy())
                here = np.flatnonzero((where < len(uid)) & (uid[np.minimum(where, len(uid) - 1)] == found.column("uid").to_numpy()))
                where, found = where[here], found.take(pa.array(here))
                start, count, anchor, weight = (found.column(c).to_numpy().astype(np.int64) for c in ("start", "n", "anchor", "weight"))
                for first, t in _words(rows):
                    mine = np.flatnonzero((where >= first) & (where < first + len(t.doc_start) - 1))
                    if not len(mine):
                        continue
                    n = count[mine]
                    at = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    row = np.repeat(where[mine], n)
                    contents = Sequence(t.hashes).of(t.doc_start[row - first] + at, window)
                    columns = [pa.array(uid[row]), pa.array(at, pa.int32()), pa.array(np.repeat(anchor[mine], n)), pa.array(contents.view(np.int64)), pa.array(np.repeat(weight[mine], n), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["uid", "at", "anchor", "contents", "weight"])

    return texts.select("uid", "text").mapInArrow(checked, "uid bigint, at int, anchor bigint, contents bigint, weight int")


@dataclass
class Parse:
    """Numbered texts, and where the copied windows of each lie: (uid, start, n) are n windows from the word ``start`` on."""

    texts: DataFrame
    copied: DataFrame
    folder: str
    window: int


def parse(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> Parse:
    """Factors every document against the phrases of all others and of its own other places."""
    texts = number(docs, id_col, text_col)
    index = written(_parsed(texts, window), "phrases")
    # what is grouped is written before it is joined, so that Spark can split the join's hot keys
    shared = written(index.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    near = written(index.join(shared, "anchor", "left_semi"), "shared")
    discard(index, shared)
    whole = written(near.groupBy("anchor", "contents").agg(F.count("*").alias("c"), F.min("uid").alias("chosen")), "contents")
    mixed = written(whole.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("mixed")), "mixed")
    known = whole.join(mixed, "anchor", "left").where("c > 1 OR mixed")
    found = written(near.join(known, ["anchor", "contents"]).select("uid", "start", "n", "anchor", "c", F.coalesce("mixed", F.lit(False)).alias("mixed"), "chosen"), "found")
    discard(near, whole, mixed)
    ask = found.where("mixed AND (c = 1 OR uid = chosen)").select("uid", "start", "n", "anchor", F.when(F.col("c") > 1, 2).otherwise(1).alias("weight"))
    windows = written(_boundary_windows(texts, answer(ask, "boundaries"), window), "windows")
    twice = written(windows.groupBy("anchor", "contents").agg(F.sum("weight").alias("c")).where("c > 1").select("anchor", "contents"), "twice")
    single = windows.where("weight = 1").join(twice, ["anchor", "contents"], "left_semi").select("uid", F.col("at").alias("start"), F.lit(1).alias("n"))
    copied = found.where("c > 1").select("uid", "start", "n").unionAll(single)
    folder = answer(copied, "copied")
    discard(found, windows, twice)
    copied = texts.sparkSession.read.schema(copied.schema).parquet(folder)
    return Parse(texts, copied, folder, window)


def _kept(p: Parse, kind: str, shown: str, of) -> DataFrame:
    """Rows (id, words, words removed, and what ``of`` makes of the kept words joined by one space), without shuffling the texts."""
    folder, window = p.folder, p.window

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folder)
        for b in batches:
            for block, rows in by_block(b):
                uid, found = rows.column(0).to_numpy(), answers.of(block)
                asked = np.zeros(0, np.int64) if found is None else found.column("uid").to_numpy()
                where = np.searchsorted(uid, asked)
                here = np.flatnonzero((where < len(uid)) & (uid[np.minimum(where, len(uid) - 1)] == asked)) if len(asked) else asked
                where = where[here]
                start, count = (np.zeros(0, np.int64),) * 2 if found is None else (found.column(c).to_numpy()[here].astype(np.int64) for c in ("start", "n"))
                for first, t in _words(rows):
                    texts = len(t.doc_start) - 1
                    mine = (where >= first) & (where < first + texts)
                    begin = t.doc_start[where[mine] - first] + start[mine]
                    edge = np.zeros(len(t.hashes) + 1, np.int64)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + count[mine] + window - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    n_words = np.diff(t.doc_start)
                    n_kept = np.diff(np.concatenate([[0], np.cumsum(stay)])[t.doc_start])
                    # the kept words' bytes, each word followed by one space
                    size = (t.end - t.begin + 1)[stay]
                    out_end = np.cumsum(size)
                    source = np.repeat(t.begin[stay] - (out_end - size), size) + np.arange(out_end[-1] if len(out_end) else 0)
                    out = t.data[np.minimum(source, max(0, len(t.data) - 1))] if len(t.data) else t.data
                    out[out_end - 1] = 0x20
                    cut = np.concatenate([[0], out_end])[np.concatenate([[0], np.cumsum(n_kept)])]
                    raw = out.tobytes()
                    made = [of(raw[cut[i] : max(cut[i], cut[i + 1] - 1)]) for i in range(texts)]
                    yield pa.RecordBatch.from_arrays([rows.column(1).slice(first, texts), pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), pa.array(made, pa.string())], ["id", "n_words", "n_removed", shown])

    return p.texts.mapInArrow(kept, f"id {kind}, n_words bigint, n_removed bigint, {shown} string")


def stripped(p: Parse) -> DataFrame:
    """(id, n_words, n_removed, kept): every text without its duplicate spans, words joined by one space."""
    return _kept(p, dict(p.texts.dtypes)["id"], "kept", lambda raw: raw.decode())


def spans(p: Parse) -> DataFrame:
    """(id, start, end): the duplicate spans as ranges of words, overlapping and adjoining ones merged, a row each."""
    ranges = p.copied.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + p.window - 1).alias("end")))).alias("r"))
    step = """aggregate(r, CAST(array() AS array<struct<start: int, end: int>>), (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).end >= x.start
      THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))) ELSE concat(a, array(named_struct('start', x.start, 'end', x.end))) END)"""
    merged = ranges.select("uid", F.explode(F.expr(step)).alias("s"))
    return merged.join(p.texts.select("uid", "id"), "uid").select("id", "s.start", "s.end")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every document."""
    p = parse(docs)
    return _kept(p, dict(p.texts.dtypes)["id"], "kept_sha256", lambda raw: hashlib.sha256(raw).hexdigest()).withColumnRenamed("id", "doc_id")


def oracle_sql(window: int = WINDOW) -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
  w AS (SELECT uid, i, array_to_string(list_slice(ws, i, i + {window - 1}), ' ') AS s FROM (SELECT uid, ws, unnest(generate_series(1, len(ws) - {window - 1})) AS i FROM d)),
  r AS (SELECT DISTINCT uid, unnest(generate_series(i, i + {window - 1})) AS i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
  p AS (SELECT uid, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM d),
  k AS (SELECT uid, count(*) FILTER (r.i IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (r.i IS NULL), '') AS kept FROM p LEFT JOIN r USING (uid, i) GROUP BY uid)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (uid)"""
