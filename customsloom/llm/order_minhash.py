"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its lower-cased words; its k-mers are the runs of five words, each labelled with how often it occurred before, so
that repeats count.  A sketch takes the ``per_sketch`` k-mers of least hash and keeps them in the order of the text; two texts
share it with a chance that falls with their edit similarity.  Of equal texts one stands for all.  Texts with a sketch in
common are a bucket; in each, every text is aligned with the bucket's leader (chosen by a hash of its own for each sketch).
Then two components of linked texts in each bucket that holds several lead and are aligned with the others there: the one with
the text of most links, and one by another hash.  These rounds find most links at little cost.  At last every pair of texts in
a bucket that are still in different components is taken: those whose lengths or counts of k-mers by cells of their hash (an
upper bound of the k-mers in common) exclude a similarity of 0.8 fall, all others are aligned.  So the links are those of all
pairs that share a sketch.  Large buckets are dealt in blocks of two chunks.

Similarity of two texts: k-mers matched in order (longest common subsequence) over all k-mers, m / (n1 + n2 - m); at least 0.8.
It equals the multiset Jaccard similarity of the k-mers wherever these keep their order, and is below it elsewhere.

With 32 sketches of 6 k-mers a pair of similarity 0.8 is missed with a chance of 6e-5 before its group's other links; texts of
at most 30 k-mers have 8 further sketches of one k-mer each.

Defined cases.  Texts without words (null, empty, signs only) are alone.  Texts of one to four words match only equal ones.
Case, white space and punctuation don't count.  A class is named by its least id; null ids have the class of their text, null
if it has no other id.  Rows with equal ids and texts are copies.  Other columns are ignored (``classes``) or kept (``deduplicate``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from customsloom.llm.common import U64, blocks, bounded_batches, discard, grams, lowered, mix, tokenise, written
from customsloom.llm.components import connected_components

WORDS = 5
LEAST = 0.8
SKETCHES = 32
PER_SKETCH = 6
#: Texts of at most so many k-mers get SHORT_SKETCHES sketches of a single k-mer, too.
SHORT, SHORT_SKETCHES = 30, 8
_SEEDS = mix(np.arange(1, SKETCHES + SHORT_SKETCHES + 1, dtype=U64) * U64(0xA24BAED4963EE407))
_CELLS = 1 << 18
#: Least and most cells of a text's counts of k-mers; most bytes and texts of a chunk of a bucket, about.
COUNT_CELLS = (64, 4096)
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 2_048


def labelled(h: np.ndarray) -> np.ndarray:
    """K-mer hashes mixed with the number of earlier occurrences of each."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if not same.any():
        return h
    at = np.arange(len(s))
    rank = at - np.maximum.accumulate(np.where(same, 0, at))
    out = h.copy()
    with np.errstate(over="ignore"):
        out[order] = mix(s + rank.astype(U64) * U64(0x9E3779B97F4A7C15))
    return out


def sketches(h: np.ndarray) -> np.ndarray:
    """One 64-bit signature per sketch of a text's k-mer hashes in text order."""
    h = labelled(h)
    n, out = len(h), []
    plan = [(0, SKETCHES, min(PER_SKETCH, n))] + ([(SKETCHES, SKETCHES + SHORT_SKETCHES, 1)] if n <= SHORT else [])
    with np.errstate(over="ignore"):
        for lo, hi, take in plan:
            step = max(1, _CELLS // n)
            for a in range(lo, hi, step):
                seeds = _SEEDS[a : min(hi, a + step)]
                v = (h[None, :] ^ seeds[:, None]) * U64(0xD6E8FEB86659FD93)
                v ^= v >> U64(32)
                v *= U64(0xD6E8FEB86659FD93)
                least = np.sort(np.argpartition(v, take - 1, axis=1)[:, :take], axis=1) if take < n else np.broadcast_to(np.arange(n), v.shape)
                sig = seeds.copy()
                for j in range(least.shape[1]):
                    sig = (sig ^ h[least[:, j]]) * U64(0x9E3779B97F4A7C15)
                    sig ^= sig >> U64(29)
                out.append(mix(sig))
    return np.concatenate(out)


def cell_counts(h: np.ndarray) -> bytes:
    """Counts of a text's labelled k-mers by the low bits of their hash, a byte a cell; empty where a count doesn't fit."""
    size = min(COUNT_CELLS[1], max(COUNT_CELLS[0], 1 << (len(h) - 1).bit_length()))
    counts = np.bincount((labelled(h) & U64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def possible(kmers: np.ndarray, component: np.ndarray, side: np.ndarray | None, counts: list[bytes], least: float = LEAST) -> Iterator[tuple[int, np.ndarray]]:
    """(text, later texts) of different components (and sides, where given) whose similarity may reach ``least``.

    Two texts have at most as many k-mers in common as the sum of the lesser counts of each cell; the larger of two unequal
    numbers of cells is folded, which keeps that true.
    """
    size = np.array([len(c) for c in counts])
    tables = {k: np.frombuffer(b"".join(c for c in counts if len(c) == k), np.uint8).reshape(-1, k) for k in set(size.tolist()) - {0}}
    place = np.zeros(len(size), np.int64)
    for k in tables:
        place[size == k] = np.arange((size == k).sum())
    folds: dict[tuple[int, int], np.ndarray] = {}

    def folded(k: int, to: int) -> np.ndarray:
        if (k, to) not in folds:
            folds[k, to] = tables[k] if k == to else tables[k].reshape(-1, k // to, to).sum(1, dtype=np.uint16)
        return folds[k, to]

    for i in range(len(size) - 1):
        apart = component[i + 1 :] != component[i]
        if side is not None:
            apart &= side[i + 1 :] != side[i]
        at = i + 1 + np.flatnonzero(apart)
        at = at[np.minimum(kmers[at], kmers[i]) >= least * np.maximum(kmers[at], kmers[i])]
        most = np.minimum(kmers[at], kmers[i]).astype(np.int64)
        for k in set(size[at].tolist()) - {0} if size[i] else ():
            own, to = size[at] == k, min(k, int(size[i]))
            most[own] = np.minimum(folded(k, to)[place[at[own]]], folded(int(size[i]), to)[place[i]]).sum(1, dtype=np.int64)
        at = at[most / (kmers[at] + kmers[i] - most) >= least]
        if len(at):
            yield i, at


def fingerprints(hashes: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's words in order; 0 for none."""
    out = np.zeros(len(doc_start) - 1, U64)
    full = np.flatnonzero(np.diff(doc_start))
    if len(full):
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(hashes), 0xF1357AEA2E62A9C5, U64)]))
            inverse = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(hashes), pow(0xF1357AEA2E62A9C5, -1, 1 << 64), U64)]))
            first = doc_start[:-1][full]
            out[full] = mix(np.add.reduceat(hashes * power[: len(hashes)], first) * inverse[first]) | U64(1)
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> tuple[float, float]:
    """(upper bound: multiset Jaccard, aligned similarity or 0 where that bound is below ``least``) of two k-mer sequences."""
    n = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0, 0.0
    x, y = labelled(a), labelled(b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    most = common / (n - common)
    if most < least:
        return most, 0.0
    matched = _aligned(a, b, x, y, common, int(n * (1 - least) / (1 + least)))
    return most, matched / (n - matched)


def _aligned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, common: int, band: int) -> int:
    """Length of the longest common subsequence within a band around the diagonal, wide enough for any pair that is similar.

    If the common labelled k-mers stand in one order in both texts, they are that subsequence; else the band is worked through.
    """
    _, at_a, at_b = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if (np.diff(at_b[np.argsort(at_a)]) > 0).all():
        return common
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[len(a) - (short - head) :][::-1] != b[len(b) - (short - head) :][::-1])
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    # row[k] is the best for the first i of a and the first i - band + k of b
    width, pad = 2 * band + 1, U64(0)
    padded = np.concatenate([np.full(band, pad), b, np.full(band + len(a) + 1, pad)])
    inside = np.concatenate([np.zeros(band, bool), np.ones(len(b), bool), np.zeros(band + len(a) + 1, bool)])
    row = np.zeros(width, np.int32)
    for i in range(len(a)):
        hit = (padded[i : i + width] == a[i]) & inside[i : i + width]
        up = np.append(row[1:], 0)
        row = np.maximum.accumulate(np.maximum(row + hit, up))
    end = len(b) - len(a) + band
    return head + tail + (int(row[min(end, width - 1)]) if end >= 0 else 0)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text to id, text's fingerprint (null without words), number of k-mers, signatures, counts by cells."""
    for b in batches:
        prints, sizes, signatures, counts = [], [], [], []
        for _, data, offsets in blocks(lowered(b.column(1).cast(pa.large_string()))):
            t = tokenise(data, offsets, words_only=True)
            prints.append(fingerprints(t.hashes, t.doc_start))
            h = grams(t.hashes, WORDS)
            for lo, hi in zip(t.doc_start[:-1], t.doc_start[1:] - WORDS + 1, strict=True):
                sizes.append(max(0, hi - lo))
                signatures.append(sketches(h[lo:hi]).view(np.int64) if hi > lo else np.zeros(0, np.int64))
                counts.append(cell_counts(h[lo:hi]) if hi > lo else b"")
        if prints:
            p = np.concatenate(prints)
            ends = np.cumsum([0, *map(len, signatures)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p.view(np.int64), mask=p == 0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(signatures))), pa.array(counts, pa.binary())],
                ["id", "print", "kmers", "signatures", "counts"],
            )


def _printed(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Adds the fingerprint of column ``at``."""
    for b in batches:
        p = [fingerprints(t.hashes, t.doc_start) for _, d, o in blocks(lowered(b.column(at).cast(pa.large_string()))) for t in [tokenise(d, o, words_only=True)]]
        if p:
            p = np.concatenate(p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.view(np.int64), mask=p == 0)], [*(f"c{i}" for i in range(b.num_columns)), "print"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns a, b, text_a, text_b to a, b, distance (1 - upper bound), similar."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            sides = []
            for c in (2, 3):
                seq = []
                for _, data, offsets in blocks(lowered(part.column(c).cast(pa.large_string()))):
                    t = tokenise(data, offsets, words_only=True)
                    h = grams(t.hashes, WORDS)
                    seq += [h[s : max(s, e - WORDS + 1)] for s, e in zip(t.doc_start[:-1], t.doc_start[1:], strict=True)]
                sides.append(seq)
            got = [similarity(x, y) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([1 - m for m, _ in got]), pa.array([s >= LEAST for _, s in got])], ["a", "b", "distance", "similar"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("print").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("print").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verified, "a bigint, b bigint, distance double, similar boolean")


def _unexcluded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column texts (of a block: print, kmers, component, side, counts) to a, b: pairs that no bound excludes."""
    for b in batches:
        for k in range(b.num_rows):
            t = b.column(0).slice(k, 1).flatten()
            name, kmers, component, side = (t.field(c).to_numpy(zero_copy_only=False) for c in ("print", "kmers", "component", "side"))
            left, right, held = [], [], 0
            for i, at in possible(kmers, component, side if side.any() else None, t.field("counts").to_pylist()):
                left.append(np.minimum(name[at], name[i]))
                right.append(np.maximum(name[at], name[i]))
                held += len(at)
                if held > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                    left, right, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _rest(members: DataFrame, distinct: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b): all pairs of texts of different components with a bucket in common that no bound excludes."""
    known = members.select("sig", "print", "kmers").join(parts.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    room = F.sum(F.least(F.greatest(F.col("kmers") * 2, F.lit(COUNT_CELLS[0])), F.lit(COUNT_CELLS[1])))
    mixed = known.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), room.alias("room"))
    # a pair alone in its bucket is tested: one of the two leads
    mixed = mixed.where("lo != hi AND n > 2").select("sig", F.ceil(F.greatest(F.col("n") / CHUNK_TEXTS, F.col("room") / CHUNK_BYTES)).alias("chunks"))
    rows = known.join(mixed, "sig").withColumn("chunk", F.pmod(F.xxhash64("print", F.lit(3)), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    rows = rows.join(distinct.select("print", "counts"), "print")
    text = F.struct("print", "kmers", "component", (F.col("chunk") > F.col("other")).cast("int").alias("side"), "counts")
    block = rows.groupBy("sig", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).agg(F.collect_list(text).alias("texts"))  # two chunks
    return block.select("texts").mapInArrow(_unexcluded, "a bigint, b bigint").distinct()


def _joined(parts: DataFrame, new: DataFrame) -> DataFrame:
    """Components after the links a, b of ``new`` between components of before, which they join."""
    if not new.limit(1).count():
        return parts
    name = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    new = new.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    joined = written(connected_components(new).select(F.col("node").alias("component"), F.col("component").alias("whole")), "joined")
    before = parts.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(parts.select("node"), "node", "left_anti")
    out = written(before.unionAll(alone), "parts")
    discard(joined)
    return out


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, print) of every row, and (print, id, class) of every print: its least id, and the component or else the print itself; both written."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("id", "text")
    kind = dict(docs.dtypes)["id"]
    sketched = rows.mapInArrow(_sketched, f"id {kind}, print bigint, kmers int, signatures array<bigint>, counts binary")
    sketched = written(sketched, "sketches")
    distinct = sketched.where("print IS NOT NULL").groupBy("print").agg(F.min("id").alias("id"), F.first("kmers").alias("kmers"), F.first("signatures").alias("signatures"), F.first("counts").alias("counts"))
    distinct = written(distinct, "distinct")
    each = distinct.select("print", "id", "kmers", F.explode("signatures").alias("sig"))
    order = F.struct(F.xxhash64("sig", "print"), F.col("print"))
    leaders = each.groupBy("sig").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1").select("sig", F.col("o.print").alias("leader"))
    members = written(each.join(leaders, "sig"), "members")
    needed = members.select("print", "id").distinct()
    texts = docs.select("id", "text").mapInArrow(lambda b: _printed(b, 1), f"id {kind}, text string, print bigint")
    texts = texts.join(needed.withColumnsRenamed({"id": "rep", "print": "p"}), F.expr("id <=> rep AND print = p")).select("print", "text")
    texts = written(texts.dropDuplicates(["print"]), "texts")
    stars = members.where("print != leader").select(F.col("leader").alias("a"), F.col("print").alias("b")).distinct()
    tested = written(_verify(stars, texts), "tested")
    parts = connected_components(tested.where("similar"))
    # in each bucket that holds several components two of them lead: that of the best-linked text, and one by another hash
    degree = tested.where("similar").select(F.explode(F.array("a", "b")).alias("print")).groupBy("print").agg(F.count("*").alias("degree"))
    placed = parts.withColumnRenamed("node", "print").join(degree, "print", "left")
    known = members.join(placed, "print", "left").select("sig", "print", "kmers", F.coalesce("component", "print").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    linked = F.struct("degree", F.xxhash64("sig", "print", F.lit(1)).alias("h"), "print", "kmers")
    other = F.struct(F.lit(0).cast("bigint").alias("degree"), F.xxhash64("sig", "print", F.lit(2)).alias("h"), "print", "kmers")
    chosen = known.groupBy("sig", "component").agg(F.max(linked).alias("r1"), F.max(other).alias("r2"))
    leads = chosen.groupBy("sig").agg(F.max(F.struct("r1", "component")).alias("l1"), F.max(F.struct("r2", "component")).alias("l2"), F.count("*").alias("n")).where("n > 1")
    meets = F.array(*(F.struct(F.col(f"r{i}").alias("x"), F.col(f"l{i}.r{i}").alias("y"), (F.col("component") != F.col(f"l{i}.component")).alias("apart")) for i in (1, 2)))
    pairs = chosen.join(leads, "sig").select(F.explode(F.filter(meets, lambda m: m["apart"])).alias("m"))
    pairs = pairs.where(f"least(m.x.kmers, m.y.kmers) >= {LEAST} * greatest(m.x.kmers, m.y.kmers)").select(F.least("m.x.print", "m.y.print").alias("a"), F.greatest("m.x.print", "m.y.print").alias("b")).distinct()
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(_verify(pairs.join(done, ["a", "b"], "left_anti"), texts), "tested")
    parts = _joined(parts, more.where("similar"))
    done = done.unionAll(more.select("a", "b"))
    rest = written(_rest(members, distinct, parts).join(done, ["a", "b"], "left_anti"), "rest")
    if rest.limit(1).count():
        parts = _joined(parts, _verify(rest, texts).where("similar"))
    discard(members, texts, tested, more, rest)
    named = distinct.select("print", "id").join(parts.withColumnRenamed("node", "print"), "print", "left")
    named = written(named.select("print", "id", F.coalesce("component", "print").alias("class")), "prints")
    rows = written(sketched.select("id", "print"), "rows")
    discard(distinct, sketched)
    return rows, named


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (least id of its near-duplicates)."""
    rows, prints = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    names = prints.groupBy("class").agg(F.min("id").alias("class_id"))
    named = prints.join(names, "class").select(F.col("print").alias("p"), "class_id")
    out = rows.join(named, F.col("print") == F.col("p"), "left").select("id", F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row of each class: that of the least id (a null id counts as the largest)."""
    rows, prints = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    discard(rows)
    kept = prints.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "print")).alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.print").alias("kept_print"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)) + ", print bigint"
    at, text_at = names[docs.columns.index(id_col)], docs.columns.index(text_col)
    printed = docs.mapInArrow(lambda b: _printed(b, text_at), schema)
    alone = printed.where("print IS NULL")
    one = printed.join(kept, F.expr(f"{at} <=> kept_id AND print = kept_print"), "left_semi").dropDuplicates([at, "print"])
    return alone.unionAll(one).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
