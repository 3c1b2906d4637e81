"""Documents to a training mix: language ID, near-duplicates, benchmark passages, domain weights.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.  All but the last return the
columns of ``documents``; the last adds n_tokens, the domains' posteriors and each document's rate, and leaves out rate 0.

Defined cases, of every stage.  Null and empty texts have no letter and go with the first stage; where the stages are called by
themselves, near-duplicates and benchmark passages keep them, and the mix gives them the rate of an empty text.  Repeated rows
are near-duplicates: one stays.  Null ids are carried through.  Without labelled languages every text with a letter stays, without
items every text, without labels every text at rate 1.  Ties go to the least id.  Empty tables give empty tables.  Further columns
are kept, but for those of the names that the last stage adds (n_tokens, p_high, p_low, p_toxic, rate), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.llm import mixing, order_minhash, ppm_language, string_tiling
from customsloom.llm.common import bounded_batches, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: those without letters and those that fit no language better than the rest go."""
    bounded_batches(spark)
    return ppm_language.keep_identified(docs, ppm_language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no item of ``benchmark``."""
    bounded_batches(spark)
    return string_tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rates at which the domains of ``labels`` meet their target weights; rate 0 goes."""
    bounded_batches(spark)
    out = mixing.mix(docs, table(spark, sf_dir, "labels"), mixing.label_domain(), mixing.TARGETS)
    posteriors = {f"p_{d}": F.coalesce(F.col("posteriors")[d], F.lit(0.0)) for d in sorted(mixing.TARGETS)}
    return out.where("rate > 0").withColumns(posteriors).drop("posteriors")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("target_weights", target_weights),
]

#: A language model, alignments and fitted rates are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
