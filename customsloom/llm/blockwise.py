"""Texts in numbered blocks, and answers that come back to them without shuffling the texts.

Some operators read every text more than once: first to ask something of the whole corpus (how often does this phrase occur?),
then to use the answers.  ``number`` writes the texts once, each with a number whose upper bits name its block of at most
``BLOCK_TEXT`` bytes or 65,536 rows.  Questions and answers are small rows that Spark groups and joins; ``answer`` writes the answers
in folders by run of blocks, and a task that reads a block's texts again opens just its answers.  The number is stored with the
row, so that it holds whatever tasks later read the table, also after executors are lost.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from customsloom.llm.common import bounded_batches, mounted, new_folder

BLOCK_TEXT = 8 << 20
ROW_BITS, RUN_BITS = 16, 2  # rows of a block; blocks of a folder of answers


def number(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, text) of all rows, written to the shared folder; a null text stays null."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    bounded_batches(spark)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row, size = TaskContext.get().partitionId() << 24, 0, 0
        for b in batches:
            uid = np.empty(b.num_rows, np.int64)
            for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()):
                if row >> ROW_BITS or row and size + n > BLOCK_TEXT:
                    block, row, size = block + 1, 0, 0
                uid[i] = block << ROW_BITS | row
                row, size = row + 1, size + n
            yield pa.RecordBatch.from_arrays([pa.array(uid), b.column(0), b.column(1)], ["uid", "id", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(numbered, f"uid bigint, id {kind}, text string")
    at = new_folder(spark, "texts")
    rows.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(rows.schema).parquet(at)
    out.written_at = at  # type: ignore[attr-defined]
    return out


def answer(rows: DataFrame, name: str, key: str = "uid", bits: int = ROW_BITS) -> str:
    """Writes rows with a text's number (or a block's, with bits=0) under ``key`` where ``Answers`` finds them; gives the folder."""
    at = new_folder(rows.sparkSession, name)
    run = F.shiftright(key, bits + RUN_BITS)
    rows.withColumn("run", run).repartition("run").write.partitionBy("run").parquet(at)
    return at


class Answers:
    """The answers of one block after another, as a task opens them."""

    def __init__(self, folder: str, key: str = "uid", bits: int = ROW_BITS):
        self.path, self.key, self.bits = mounted(folder), key, bits
        self.run, self.table = -1, None

    def of(self, block: int) -> pa.Table | None:
        """The block's rows, or None if it has none."""
        if block >> RUN_BITS != self.run:
            self.run, self.table = block >> RUN_BITS, None
            at = f"{self.path}/run={self.run}"
            if os.path.isdir(at):
                self.table = pa.concat_tables(pq.ParquetFile(f"{at}/{f}").read() for f in sorted(os.listdir(at)) if f.endswith(".parquet"))
        if self.table is None:
            return None
        key = self.table.column(self.key).to_numpy()
        mine = np.flatnonzero((key >> self.bits) == block)
        return self.table.take(pa.array(mine)) if len(mine) else None


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) of the runs of rows of one block; the number is the first column."""
    block = batch.column(0).to_numpy() >> ROW_BITS
    edges = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(block)], strict=True):
        if hi > lo:
            yield int(block[lo]), batch.slice(lo, hi - lo)
