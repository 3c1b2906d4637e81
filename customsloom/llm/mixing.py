"""Mixing documents to target domain weights by soft membership.

A multinomial logistic regression over hashed words, word beginnings and a few ratios of the text, fitted on a bounded sample
of the labelled table (features that tell no domain from the rest are left out of it), gives each document posteriors p of the domains.  Rates r >= 0 are then fitted so that the expected tokens of each
domain, sum of r * n * p over documents, come near target weight times all tokens: least squares, by accelerated projected
gradient.  A step needs the domains' current totals alone, a handful of numbers that Spark sums over all documents; each
document's rate follows from the steps so far, which tasks replay from those numbers.  So no rate is collected or shuffled.

Errors are relative: each domain's is over its share at rates 1.  The gradient is taken per token (preconditioned by n), which
makes a rate a function of the posteriors; the matrix of the steps is then nonnegative with the positive eigenvector
sqrt(share) of eigenvalue 1, so its Lipschitz constant is 1, and where posteriors are sure it is near the identity, so that a
few steps suffice.  ``ridge`` pulls rates towards 1 and makes them unique; ``reached`` tells how near the totals come.

A document goes (rate 0) exactly where a domain of target 0 is likelier than every other one; the rest keep a rate of at least
``LEAST_RATE``, whatever the fit.  Documents that go count for nothing in the totals, but for the domains' shares at rates 1.

Defined cases.  A null or empty text has no tokens, the posteriors of an empty text and the rate that goes with them.  Labels
that are null, or whose document isn't there, teach nothing; repeated ones count each time in the
domains' sizes and once in the sample.  Target weights of domains without
a labelled document are dropped and the rest rescaled; a domain without a target has weight 0.  Without any labelled document
posteriors are null and rates 1.  A null id is carried through.  Other columns are ignored (``rates``) or kept (``mix``).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.llm.common import U64, blocks, tokenise, written
from customsloom.llm.common import mix as mix_hash

#: Bits of a feature's hash, and the ratios of a text beside the hashed features.
BITS, DENSE = 18, 9
#: Labelled documents of a domain that the classifier is fitted on, about.
SAMPLE_DOCS = 1_000
#: Most rows, as a multiple of SAMPLE_DOCS, and most bytes of text of a domain that reach the driver.
SAMPLE_OVER, SAMPLE_BYTES = 2, 32 << 20
#: Standard errors by which a feature's document share must differ between a domain and the rest to count.
TELLING = 5.0
#: Pull of rates towards 1: large enough that a small chance of an unwanted domain lowers a rate and does not end it.
RIDGE = 0.05
#: Steps after which a solver that hasn't converged gives a warning and ends.
STEPS = 500
#: Rate of a document that the fit would end though its likeliest domain is wanted.
LEAST_RATE = 1e-3


def _table(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo:hi] = True
    return out


_LETTER, _SPACE = _table((48, 58), (65, 91), (97, 123), (128, 256)), _table((0x20, 0x21), (0x09, 0x0E))
_DIGIT, _UPPER, _CRY, _BAR, _LINE = _table((48, 58)), _table((65, 91)), _table((33, 34)), _table((124, 125)), _table((10, 11))


@dataclass
class Features:
    """Hashed words and word beginnings of a block of texts, three a word, and the ratios of each text."""

    word: np.ndarray
    start: np.ndarray
    dense: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.start) // 3


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    t = tokenise(data, offsets, words_only=True)
    size = np.maximum(np.diff(offsets), 1)
    n = np.diff(t.doc_start)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    again = np.zeros(len(t.hashes) + 1)
    if len(t.hashes):
        same = t.hashes[1:] == t.hashes[:-1]
        same[t.doc_start[1:-1][(t.doc_start[1:-1] > 0) & (t.doc_start[1:-1] < len(t.hashes))] - 1] = False
        again[2:] = np.cumsum(same)
    repeats = (again[t.doc_start[1:]] - again[t.doc_start[:-1]]) / np.maximum(n, 1)
    dense = [10 * share(~_LETTER[data] & ~_SPACE[data]), 10 * share(_DIGIT[data]), 3 * share(_UPPER[data]), 10 * share(_CRY[data]), 10 * share(_BAR[data]), np.minimum(share(_LINE[data]) * 20, 3), 5 * repeats, np.log1p(n) / 4, np.ones(len(n))]
    # a word, and its first four and five bytes where it is longer
    begin, length = t.begin, t.end - t.begin
    head = np.zeros(len(begin), U64)
    parts = [t.hashes]
    padded = np.concatenate([t.data, np.zeros(5, np.uint8)])
    for i in range(5):
        head = (head << U64(8)) | padded[begin + i].astype(U64)
        if i >= 3:
            parts.append(np.where(length > i + 1, mix_hash(head + U64(i << 40)), mix_hash(t.hashes + U64(i))))
    word = (np.stack(parts, 1).ravel() >> U64(64 - BITS)).astype(np.int64)
    return Features(word, t.doc_start * 3, np.stack(dense, 1))


@dataclass
class Classifier:
    domains: list[str]
    word: np.ndarray  # float32: hashed feature, domain
    dense: np.ndarray  # ratio, domain

    def posteriors(self, f: Features) -> np.ndarray:
        out = f.dense @ self.dense
        full = np.flatnonzero(f.n)
        if len(full):
            w = self.word[f.word]
            for d in range(len(self.domains)):
                out[full, d] += np.add.reduceat(w[:, d], f.start[:-1][full], dtype=np.float64)
        out -= out.max(1, keepdims=True)
        out = np.exp(out)
        return out / out.sum(1, keepdims=True)


def _telling(label: np.ndarray, row: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """Features whose share of documents differs clearly between some domain and the rest; of distinct (row, word)."""
    n, keep = len(label), np.zeros(1 << BITS, bool)
    seen = np.bincount(word, minlength=1 << BITS)
    for d in range(k):
        own = label == d
        a, n1, n0 = np.bincount(word[own[row]], minlength=1 << BITS), max(1, own.sum()), max(1, n - own.sum())
        p = np.clip(seen / n, 1e-9, 1 - 1e-9)
        keep |= np.abs(a / n1 - (seen - a) / n0) >= TELLING * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return keep & (seen >= 5)


def _fitted(domains: list[str], label: np.ndarray, f: Features, rounds: int = 150, decay: float = 1e-4) -> Classifier:
    """Full-batch Adam with a fixed number of rounds over the telling features; domains weigh alike."""
    k, n = len(domains), len(label)
    pair, count = np.unique((np.repeat(np.arange(n), np.diff(f.start)) << BITS) + f.word, return_counts=True)
    row, word = pair >> BITS, pair & ((1 << BITS) - 1)
    keep = _telling(label, row, word, k)
    used = keep[word]
    row, word, count = row[used], (np.cumsum(keep) - 1)[word[used]], count[used].astype(float)
    m = int(keep.sum())
    weight = (n / k / np.bincount(label, minlength=k))[label][:, None] / n
    truth = np.eye(k)[label]
    p = [np.zeros((m, k)), np.zeros((DENSE, k))]
    mean, var = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, rounds + 1):
        z = f.dense @ p[1] + np.stack([np.bincount(row, count * p[0][word, d], n) for d in range(k)], 1)
        z = np.exp(z - z.max(1, keepdims=True))
        error = (z / z.sum(1, keepdims=True) - truth) * weight
        grad = [np.stack([np.bincount(word, count * error[row, d], m) for d in range(k)], 1) + decay * p[0], f.dense.T @ error + decay * p[1]]
        for i, g in enumerate(grad):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.99 * var[i] + 0.01 * g * g
            p[i] = p[i] - 0.05 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-8)
    out = Classifier(domains, np.zeros((1 << BITS, k), np.float32), p[1])
    out.word[keep] = p[0]
    return out


def _sample(docs: DataFrame, labels: DataFrame, have: Mapping[str, int], id_col: str, text_col: str, sample_docs: int, sample_bytes: int) -> DataFrame:
    """(id, domain, text) of at most SAMPLE_OVER * sample_docs rows and sample_bytes of text a domain.

    Labels are drawn by their id, each once.  Of the documents with them only lengths and hashes are looked at first, equal texts of an id as one; where there are still
    too many (ids that repeat) or too long ones, a share of the texts is drawn by hash, and then those within the bounds in order of hash.
    """
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for d, n in sorted(have.items()) for x in (d, min(1.0, sample_docs / n))])
    picked = F.broadcast(labels.where(drawn < share[F.col("domain")]).distinct())  # about sample_docs a domain
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text", F.lit(7)))
    sizes = written(rows.select("id", "h", F.octet_length("text").cast("bigint").alias("size")).join(picked, "id").groupBy("id", "h", "domain").agg(F.max("size").alias("size")), "sample")
    fits = F.col("size") <= sample_bytes
    most = {r["domain"]: max(r["n"] / (SAMPLE_OVER * sample_docs), r["size"] / sample_bytes) for r in sizes.where(fits).groupBy("domain").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    again = F.create_map(*[F.lit(x) for d, over in sorted(most.items()) for x in (d, min(1.0, 1.5 / over if over > 1 else 1.0))]) if most else F.create_map(F.lit(""), F.lit(1.0))
    order = Window.partitionBy("domain").orderBy("h", "id")
    sizes = sizes.where(fits & ((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) < F.try_element_at(again, F.col("domain"))))
    kept = sizes.withColumns({"nth": F.row_number().over(order), "sum": F.sum("size").over(order)}).where((F.col("nth") <= SAMPLE_OVER * sample_docs) & (F.col("sum") <= sample_bytes))
    return rows.join(F.broadcast(kept.select("id", "h", "domain")), ["id", "h"]).groupBy("id", "h", "domain").agg(F.first("text").alias("text"))


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Classifier | None:
    """From about ``sample_docs`` labelled documents and at most ``sample_bytes`` of text of each domain (longer texts teach nothing); ``domain`` is an expression over ``labels``."""
    named = labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    have = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not have:
        return None
    got = _sample(docs, named, have, id_col, text_col, sample_docs, sample_bytes).select("id", "domain", "text").orderBy("id", "domain", "text").toArrow()
    names = got.column("domain").to_pylist()
    if not names:
        return None
    domains = sorted(set(names))
    parts = [features(d, o) for _, d, o in blocks(got.column("text").combine_chunks())]
    sizes = np.concatenate([np.diff(p.start) for p in parts])
    f = Features(np.concatenate([p.word for p in parts]), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p.dense for p in parts]))
    model = _fitted(domains, np.array([domains.index(x) for x in names]), f)
    prior = np.array([have[d] for d in domains], float)
    model.dense[-1] += np.log(prior / prior.sum())  # the last ratio is 1: the sample is of equal parts, the table isn't
    return model


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row, all columns, with n_tokens and its posteriors p (array in the order of model.domains)."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = [], []
            for _, data, offsets in blocks(b.column(at)):
                f = features(data, offsets)
                n.append(f.n)
                p.append(shared.value.posteriors(f))
            if n:
                p = np.concatenate(p)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(n), pa.int64()), lists], [*names, "n_tokens", "p"])

    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    return docs.mapInArrow(scored, f"{schema}, n_tokens bigint, p array<double>")


def unwanted(p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Whether a domain of weight 0 is likelier than all others, by document."""
    no = weights <= 0
    return p[:, no].max(1) > p[:, ~no].max(1) if no.any() and not no.all() else np.zeros(len(p), bool)


def replay(p: np.ndarray, gradients: list[np.ndarray], ridge: float, gone: np.ndarray | None = None, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point to take the next gradient at) of documents with posteriors p after the steps of ``gradients``; 0 where ``gone``."""
    x = y = np.ones(len(p))
    t = 1.0
    for g in gradients:
        new = np.maximum(floor, y - (p @ g + ridge * (y - 1)) / (1 + ridge))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return (x, y) if gone is None else (np.where(gone, 0.0, x), np.where(gone, 0.0, y))


def _posteriors(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def solve(members: DataFrame, weights: np.ndarray, steps: int = STEPS, ridge: float = RIDGE, tolerance: float = 1e-4, floor: float = 0.0) -> list[np.ndarray]:
    """The gradients of the steps; ``members`` has n_tokens and p.  Ends when every domain's share is twice within tolerance of its last; a warning tells if ``steps`` run out before."""
    k = len(weights)
    total = members.agg(F.sum("n_tokens")).first()[0] or 0
    gradients: list[np.ndarray] = []
    while total and len(gradients) < steps:

        def sums(batches: Iterator[pa.RecordBatch], gradients=tuple(gradients)) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * k)  # at the point of the next gradient, and at rates 1
            for b in batches:
                p, n = _posteriors(b.column(1), k), b.column(0).to_numpy()
                out[:k] += (replay(p, list(gradients), ridge, unwanted(p, weights), floor)[1] * n) @ p
                out[k:] += n @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * k), pa.int32()), pa.array(out)], ["d", "s"])

        got = members.select("n_tokens", "p").mapInArrow(sums, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect()
        sums_of = np.zeros(2 * k)
        for r in got:
            sums_of[r["d"]] = r["s"] / total
        now, share = sums_of[:k], np.maximum(sums_of[k:], 1e-9)
        gradients.append((now - weights) / share)
        if len(gradients) > 3 and all(np.abs((gradients[-i] - gradients[-i - 1]) * share).max() < tolerance for i in (1, 2)):
            return gradients
    if total:
        warnings.warn(f"rates have not converged after {steps} steps; mixing.reached tells how near they come", stacklevel=2)
    return gradients


def mix(docs: DataFrame, labels: DataFrame, domain: Column, targets: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, steps: int = STEPS, ridge: float = RIDGE) -> DataFrame:
    """All rows and columns of docs with n_tokens, posteriors (map by domain) and rate; columns of these names in the input go."""
    docs = docs.drop("n_tokens", "posteriors", "rate")
    model = fit_classifier(docs, labels, domain, id_col, text_col, sample_docs)
    if model is None:
        return docs.withColumns({"n_tokens": F.lit(None).cast("bigint"), "posteriors": F.lit(None).cast("map<string,double>"), "rate": F.lit(1.0)})
    members = written(memberships(docs, model, id_col, text_col), "members")
    wanted = np.array([max(0.0, float(targets.get(d, 0))) for d in model.domains])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(wanted), 1 / len(wanted))
    gradients, k = solve(members, wanted, steps, ridge, floor=LEAST_RATE), len(wanted)
    names = members.columns

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _posteriors(b.column(len(names) - 1), k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replay(p, gradients, ridge, unwanted(p, wanted), LEAST_RATE)[0])], [*names, "rate"])

    schema = ", ".join(f"{n} {t}" for n, t in members.dtypes)
    out = members.mapInArrow(rated, f"{schema}, rate double")
    posteriors = F.map_from_arrays(F.array(*(F.lit(d) for d in model.domains)), F.col("p"))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=False)), "n_tokens", posteriors.alias("posteriors"), "rate")


def reached(mixed: DataFrame) -> DataFrame:
    """Per domain of what ``mix`` gives: its tokens at the rates over all tokens (to hold against the targets)."""
    tokens = F.col("n_tokens").cast("double")
    each = mixed.select((F.col("rate") * tokens).alias("kept"), F.explode("posteriors").alias("domain", "p"))
    sums = each.groupBy("domain").agg(F.sum(F.col("kept") * F.col("p")).alias("s"))
    return sums.crossJoin(mixed.agg(F.sum(tokens).alias("total"))).select("domain", F.try_divide("s", "total").alias("weight"))


#: The weights that the corpus is mixed to, by the domains of label_domain().
TARGETS = {"high": 0.9, "low": 0.1, "toxic": 0.0}


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """Per document: n_tokens, its posteriors of the domains of ``labels``, and its rate."""
    out = mix(docs.select("doc_id", "text"), labels, label_domain(), targets)
    return out.select("doc_id", "n_tokens", *(F.coalesce(F.col("posteriors")[d], F.lit(0.0)).alias(f"p_{d}") for d in sorted(TARGETS)), "rate")
