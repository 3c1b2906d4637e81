"""Nearest neighbours by cosine over randomly rotated one-bit codes.

A vector is normalised, its distance to a centre taken, rotated by a fixed random rotation, and kept as one bit a dimension
with a few scalars: the rest's length, its product with the centre, and the product f of the code with the rotated unit
vector.  For a query, the product with the code over f estimates the true inner product, with an error of about
``bound`` * sqrt((1 - f^2) / f^2 / (d - 1)).  A vector is reranked, with its original components and in double precision, if its
estimate plus that error reaches the query's least good neighbour so far; the neighbours of a task's rows are merged by query.

Centre and rotation come from a bounded sample of ``sample`` vectors; every vector is indexed.  Queries go in blocks of at
most ``block`` and are broadcast a block at a time; the index is a table in the shared folder that each block scans once.

Defined cases.  Vectors that are null, empty, zero, of another length than the most frequent one, or with null or non-finite
components take no part, nor do null ids.  Ties go to the smaller id.  Rows with the query's id are its own; a repeated query
id is asked once (with the vector that sorts first).  Fewer candidates than k: all of them.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.llm.common import new_folder, written

SAMPLE = 4_096
BLOCK = 2_048
#: Standard errors within which an estimate is trusted.
BOUND = 3.0
_ROWS = 2_048


@dataclass
class Frame:
    """The centre and the rotation."""

    centre: np.ndarray
    rotation: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.centre)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed bits, scalars: length of the rest, product of the rest with the centre, f) of rows of vectors."""
        rest = x / np.linalg.norm(x, axis=1, keepdims=True) - self.centre
        length = np.linalg.norm(rest, axis=1)
        turned = rest @ self.rotation.T
        bits = turned > 0
        f = np.abs(turned).sum(1) / math.sqrt(self.dims) / np.maximum(length, 1e-30)
        return np.packbits(bits, axis=1), np.stack([length, rest @ self.centre, np.where(length > 1e-12, f, 1.0)], 1).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vector as doubles) of the rows that take part, and their length."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("v") == most["d"]), most["d"]) if most else (rows, 0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit(rows: DataFrame, dims: int, sample: int = SAMPLE, seed: int = 7) -> Frame:
    """From the ``sample`` rows whose ids hash least."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    x = _matrix(got.column("v").combine_chunks(), dims)
    centre = (x / np.linalg.norm(x, axis=1, keepdims=True)).mean(0)
    rotation, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return Frame(centre, rotation * np.sign(np.diag(r)))


def index(rows: DataFrame, frame: Frame) -> DataFrame:
    """(id, code, scalars, v) of every row, written to the shared folder."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits, scalars = frame.encode(_matrix(b.column(1), frame.dims))
                width = scalars.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scalars) + 1) * width, pa.int32()), pa.array(scalars.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in bits], pa.binary()), lists, b.column(1)], ["id", "code", "scalars", "v"])

    kind = dict(rows.dtypes)["id"]
    return written(rows.select("id", "v").mapInArrow(coded, f"id {kind}, code binary, scalars array<float>, v array<double>"), "codes")


def _best(ids: np.ndarray, x: np.ndarray, bits: np.ndarray, scalars: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, frame: Frame, k: int, bound: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the rows that may be among the k best; raises ``least`` to each query's k-th best cosine."""
    d = frame.dims
    size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    queries = vectors / size[:, None]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    rest = queries - frame.centre
    turned = (rest @ frame.rotation.T).astype(np.float32)
    f = scalars[:, 2].astype(np.float64)
    product = (turned @ signs.T).astype(np.float64) / math.sqrt(d) / f  # of the unit rest with the query's rest
    length = scalars[:, 0].astype(np.float64)
    estimate = length * product + scalars[:, 1] + queries @ frame.centre[:, None]
    error = length * np.linalg.norm(rest, axis=1)[:, None] * (bound * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(1, d - 1))) + 1e-6
    own = query_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, estimate - error)
    if low.shape[1] > k:
        least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
    q, r = np.nonzero(~own & (estimate + error >= least[:, None]))
    out = np.empty(len(q))
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    for lo in range(0, len(q), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        out[part] = np.einsum("ij,ij->i", vectors[q[part]], x[r[part]]) / (size[q[part]] * norms[r[part]])
    return q, r, out


def search(codes: DataFrame, queries: DataFrame, frame: Frame, k: int = 5, block: int = BLOCK, bound: float = BOUND) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest of ``codes`` to each row (id, v) of ``queries``."""
    spark, kind = codes.sparkSession, dict(codes.dtypes)["id"]
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    n = asked.count()
    parts, folder = max(1, math.ceil(n / block)), new_folder(spark, "neighbours")
    for part in range(parts):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), _matrix(got.column("v").combine_chunks(), frame.dims) if len(got) else np.zeros((0, frame.dims))))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, vectors = shared.value
            if not len(query_ids):
                return
            least = np.full(len(query_ids), -np.inf)
            kept = (np.zeros(0, np.int64), np.zeros(0, query_ids.dtype), np.zeros(0))
            for b in batches:
                for lo in range(0, b.num_rows, _ROWS):
                    s = b.slice(lo, _ROWS)
                    ids, x = s.column(0).to_numpy(), _matrix(s.column(3), frame.dims)
                    bits = np.frombuffer(b"".join(s.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)
                    q, r, c = _best(ids, x, bits, _matrix(s.column(2), 3), query_ids, vectors, frame, k, bound, least)
                    q, i, c = np.concatenate([kept[0], q]), np.concatenate([kept[1], ids[r]]), np.concatenate([kept[2], c])
                    order = np.lexsort((i, -c, q))
                    q, i, c = q[order], i[order], c[order]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0])) if len(q) else np.zeros(0, np.int64)
                    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                    keep = place < k
                    kept = (q[keep], i[keep], c[keep])
                    full = place == k - 1
                    least[q[full]] = np.maximum(least[q[full]], c[full] - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", "id", "score"])

        codes.select("id", "code", "scalars", "v").mapInArrow(nearest, f"query_id {kind}, id {kind}, score double").write.mode("append").parquet(folder)
    found = spark.read.schema(f"query_id {kind}, id {kind}, score double").parquet(folder)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def neighbours(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """The k nearest rows to each row for which ``asks`` (over the column id) holds: query_id, rank, vec_id, score."""
    rows, dims = usable(vectors, id_col, vector_col)
    if not dims:
        kind = dict(vectors.select(id_col).dtypes)[id_col]
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    frame = fit(rows, dims)
    codes = index(rows, frame)
    return search(codes, codes.where(asks).select("id", "v"), frame, k).withColumnRenamed("id", id_col)


def every_fiftieth(vectors: DataFrame) -> DataFrame:
    return neighbours(vectors, F.col("id") % 50 == 0)
