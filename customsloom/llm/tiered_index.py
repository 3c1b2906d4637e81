"""Ranked lexical search over a tiered index: high-impact postings first, exact by residual bounds.

A posting is a document that holds a term, with its impact (1000000000*tf) div (1000*tf + 8*m), where
m = 10 + ((90*n*N) div L).  The postings of each term are cut by impact into tiers that grow sixteenfold; a term knows the
greatest impact of each tier, so that its weight times that of the first unread tier is a residual bound on what its unread
postings can add to any document.

A search reads the first tier of every term.  An item's k-th best sum so far is a threshold that its final k-th best score can't be
below.  Terms whose residuals together stay within ``SPARE`` of the threshold need no more reading: a document met in none of
the others can't reach it.  The proof of an item is that no other term has unread postings; items that lack it fall through to
the next tier of just those terms, at worst to the end.  Documents whose sum plus the residuals of the terms they weren't met in
reaches the threshold are then scored in full, so that scores and order are exact.

Terms are known by 64-bit hashes.  Nothing is collected but two sums, the number of open items, and the asked terms' hashes
while there are at most ``MOST_TERMS`` (a filter at the source; beyond, postings of every term are kept and the join filters).

Defined cases.  Null and empty texts and texts without a term are no documents (they count in neither N nor L) and items without rows.
Every row of the documents is one of its own, also under a repeated or null id; equal scores go by ascending id, null ids last.
Rows of one item_id are one item with all their terms; items without an id take no part.  Empty tables give no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.llm.common import HashIndex, U64, blocks, bounded_batches, discard, new_folder, tokenise, written

#: Postings of the first tier of a term at least (if it has them), and how much each further tier grows.
FIRST, GROWTH = 512, 16
#: Impacts are cut into tiers at multiples of this.
STEP = 1024
#: Share of the threshold within which residuals may stay unread; the rest decides how many documents are scored in full.
SPARE = 0.5
#: Asked terms whose hashes are sent to the tasks (8 MB).
MOST_TERMS = 1 << 20


@dataclass
class Index:
    """postings: (term, uid, id, impact, tier) in folders of tiers; terms: (term, w, cuts, tops)."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    length: int


def _counted(texts: pa.Array, keep: HashIndex | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, terms of each text, then row, term and count of every kept term of every text) of runs of texts."""
    for first, data, offsets in blocks(texts):
        t = tokenise(data, offsets, words_only=True)
        doc, h = t.doc_of, t.hashes
        if keep is not None and len(h):
            hit = keep.find(h) >= 0
            doc, h = doc[hit], h[hit]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        yield first, np.diff(t.doc_start), doc[new], h[new].view(np.int64), np.diff(np.append(new, len(h)))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item."""
    kind = dict(items.dtypes)[id_col]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, row, term, _ in _counted(b.column(1), None):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + first)), pa.array(term)], ["item", "term"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(parsed, f"item {kind}, term bigint").distinct()


def _read_postings(docs: DataFrame, keep: np.ndarray | None, id_col: str, text_col: str) -> DataFrame:
    """(term, uid, id, tf, n) of every kept term of every text; a row without a term has a batch's documents (uid) and terms (n)."""
    kind = dict(docs.dtypes)[id_col]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if keep is None else HashIndex(keep)
        names = ["term", "uid", "id", "tf", "n"]
        for b in batches:
            for first, n, row, term, tf in _counted(b.column(2), known):
                place = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([pa.array(term), b.column(0).take(place), b.column(1).take(place), pa.array(tf.astype(np.int64)), pa.array(n[row].astype(np.int64))], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([int((n > 0).sum())]), pa.nulls(1, b.column(1).type), pa.nulls(1, pa.int64()), pa.array([int(n.sum())])], names)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(parsed, f"term bigint, uid bigint, id {kind}, tf bigint, n bigint")


def _tiers(postings: DataFrame, documents: int) -> DataFrame:
    """(term, w, cuts, tops): weight, least impact of each tier but the last, greatest impact of each tier."""
    levels = postings.groupBy("term", F.expr(f"impact div {STEP}").alias("level")).agg(F.count("*").alias("n"), F.max("impact").alias("top"))
    better = F.coalesce(F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tier = F.when(better < FIRST, 0).otherwise(F.floor(F.log(better / FIRST) / F.log(F.lit(float(GROWTH)))) + 1)
    each = levels.withColumn("tier", tier).groupBy("term", "tier").agg((F.min("level") * STEP).alias("cut"), F.max("top").alias("top"), F.sum("n").alias("n"))
    terms = each.groupBy("term").agg(F.sum("n").alias("df"), F.array_sort(F.collect_list(F.struct("tier", "cut", "top"))).alias("t"))
    w = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint")
    return terms.select("term", w.alias("w"), F.expr("transform(slice(t, 1, size(t) - 1), x -> x.cut)").alias("cuts"), F.expr("transform(t, x -> x.top)").alias("tops"))


def build(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index | None:
    """The index of all documents, of the given terms' postings (a column ``term``) or of all; None if no text has a term."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = None
    if terms is not None:
        asked = terms.select("term").distinct()
        got = asked.limit(MOST_TERMS + 1).toArrow().column("term").to_numpy()
        keep = got.view(U64) if len(got) <= MOST_TERMS else None
    read = written(_read_postings(docs, keep, id_col, text_col), "postings")
    documents, length = read.where("term IS NULL").agg(F.sum("uid"), F.sum("n")).first()
    if not length:
        return None
    m = f"({100 - 90} + ((90 * n * {documents}) div {length}))"
    rows = read.where("term IS NOT NULL").select("term", "uid", "id", F.expr(f"CAST((1000000000 * tf) div (1000 * tf + 8 * {m}) AS INT)").alias("impact"))
    if terms is not None and keep is None:
        rows = rows.join(asked, "term", "left_semi")
    tiers = written(_tiers(rows, documents), "terms")
    folder = new_folder(spark, "tiers")
    tiered = rows.join(tiers.select("term", "cuts"), "term").withColumn("tier", F.expr("size(filter(cuts, c -> impact < c))")).drop("cuts")
    tiered.write.partitionBy("tier").parquet(folder)
    discard(read)
    postings = spark.read.schema(tiered.schema).parquet(folder)
    postings.written_at = folder  # type: ignore[attr-defined]
    return Index(postings, tiers, documents, length)


def _residual(t: Column) -> Column:
    """What a term's unread postings can add at most."""
    return F.when(t["read"] < F.size(t["tops"]), t["w"] * F.get(t["tops"], t["read"])).otherwise(F.lit(0).cast("bigint"))


def _sums(items: DataFrame, postings: DataFrame) -> DataFrame:
    """(item, uid, id, low, seen): what was read of each document for each item, and the residuals of the terms it was met in."""
    asked = items.select("item", F.explode("terms").alias("t")).select("item", "t.term", "t.w", "t.read", _residual(F.col("t")).alias("residual"))
    hits = asked.join(postings, "term").where("tier < read")
    return hits.groupBy("item", "uid").agg(F.min("id").alias("id"), F.sum(F.col("w") * F.col("impact")).alias("low"), F.sum("residual").alias("seen"))


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _judged(items: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Items with their threshold, the sum of residuals, terms from the least residual on, and how many of these may stay unread.

    An item's terms are one row: they are as many as its text has."""
    rows = items.join(thresholds, "item", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))
    rows = rows.withColumn("terms", F.array_sort(F.transform("terms", lambda t: F.struct(_residual(t).alias("residual"), t["term"].alias("term"), t["w"].alias("w"), t["tops"].alias("tops"), t["read"].alias("read")))))
    unread = F.expr(f"transform(terms, (t, i) -> aggregate(slice(terms, 1, i + 1), 0L, (a, x) -> a + x.residual) <= threshold * {SPARE} OR t.residual = 0)")
    return rows.withColumns({"all": F.expr("aggregate(terms, 0L, (a, x) -> a + x.residual)"), "spared": F.size(F.filter(unread, lambda x: x))})


def search(index: Index, items: DataFrame, k: int = 10) -> tuple[DataFrame, list[int]]:
    """(item, rank, id, score) of the k best documents of each (item, term), and how many items were open before each tier."""
    spark, kind = items.sparkSession, dict(items.dtypes)["item"]
    known = items.join(index.terms, "term").groupBy("item").agg(F.collect_list(F.struct("term", "w", "tops", F.lit(1).alias("read"))).alias("terms"))
    state = written(known, "asked")
    done, opened = [], []
    while n := state.count():
        opened.append(n)
        top = _best(_sums(state, index.postings), k, F.desc("low"))
        threshold = top.groupBy("item").agg(F.when(F.count("*") >= k, F.min("low")).otherwise(0).alias("threshold"))
        done.append(written(_judged(state, threshold), "round"))
        deeper = F.transform("terms", lambda t, i: F.struct(t["term"].alias("term"), t["w"].alias("w"), t["tops"].alias("tops"), (t["read"] + (i >= F.col("spared")).cast("int")).alias("read")))
        old, state = state, written(done[-1].where("spared < size(terms)").select("item", deeper.alias("terms")), "asked")
        discard(old)
    discard(state)
    if not done:
        return spark.createDataFrame([], f"item {kind}, rank int, id {dict(index.postings.dtypes)['id']}, score bigint"), opened
    proven = done[0].where("spared = size(terms)")
    for part in done[1:]:
        proven = proven.unionAll(part.where("spared = size(terms)"))
    proven = written(proven.drop("spared"), "proven")
    discard(*done)
    near = _sums(proven, index.postings).join(proven.select("item", "threshold", "all"), "item").where("low + all - seen >= threshold").select("item", "uid")
    asked = proven.select("item", F.explode("terms").alias("t")).select("item", "t.term", "t.w")
    rest = near.join(index.postings, "uid").join(asked, ["item", "term"])
    full = rest.groupBy("item", "uid").agg(F.min("id").alias("id"), F.sum(F.col("w") * F.col("impact")).alias("score")).where("score > 0")
    return _best(full, k, F.desc("score"), F.asc_nulls_last("id"), "uid").select("item", "rank", "id", "score"), opened


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents of highest score above 0 for every item."""
    asked = written(item_terms(items), "terms")
    index = build(docs, asked)
    if index is None:
        return docs.sparkSession.createDataFrame([], f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id {dict(docs.dtypes)['doc_id']}, score bigint")
    found, _ = search(index, asked, k)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def oracle_sql() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all({lowered}, '{_TERM}') AS ts FROM documents),
  p AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d), t AS (SELECT doc_id, term, n, count(*) AS tf FROM p GROUP BY ALL),
  s AS (SELECT count(*) AS nd, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
  f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, nd),
  i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({lowered}, '{_TERM}')) AS term FROM benchmark),
  x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * nd) // l))))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN t USING (term), s GROUP BY 1, 2),
  r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
