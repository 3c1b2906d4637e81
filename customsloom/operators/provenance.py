"""Why candidates were not used: each is carried through all filters with the first one that takes it, instead of being dropped.

Counts of every reason add up to the candidates of a query.  A query's own reason is that of the last filter at which it still had
candidates; queries without any have the reason of nothing found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KEPT, NOTHING = "kept", "no_fts_match"


def traced(candidates: DataFrame, filters: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds ``reason`` (the first filter whose condition doesn't hold, else kept) and ``stage`` (how many hold before it).  Null doesn't hold."""
    reason, stage = F.lit(KEPT), F.lit(len(filters))
    for i, (name, holds) in reversed(list(enumerate(filters))):
        fails = ~F.coalesce(holds, F.lit(False))
        reason, stage = F.when(fails, name).otherwise(reason), F.when(fails, i).otherwise(stage)
    return candidates.withColumns({"reason": reason, "stage": stage})


def reasons(queries: DataFrame, rows: DataFrame, key: str, best: Sequence[Column]) -> DataFrame:
    """Per query: candidates, kept, its reason, a map of candidates by reason, and the ``best`` columns of its furthest candidate.

    The furthest candidate is that of the highest stage, then of the greatest ``best`` columns.  One row for each row of ``queries``."""
    counts = rows.groupBy(key, "reason").agg(F.count("*").alias("n"))
    by_reason = counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("by_reason"), F.sum("n").alias("candidates"))
    furthest = rows.groupBy(key).agg(F.max(F.struct("stage", *(c.alias(f"b{i}") for i, c in enumerate(best)), "reason")).alias("f"))
    out = queries.join(by_reason, key, "left").join(furthest, key, "left")
    kept = F.coalesce(F.try_element_at("by_reason", F.lit(KEPT)), F.lit(0))
    return out.select(
        *queries.columns, F.coalesce("candidates", F.lit(0)).alias("candidates"), kept.alias("kept"), F.coalesce("f.reason", F.lit(NOTHING)).alias("reason"), "by_reason", *(F.col(f"f.b{i}").alias(f"best{i}") for i in range(len(best)))
    )


def knowledge_filters(least_declarations: int, least_confidence: float, allowed: Column) -> list[tuple[str, Column]]:
    """The filters of historical candidates (declarations, confidence, country_match), in order; a low country match is named before a low confidence."""
    sure = F.col("confidence") >= least_confidence
    return [
        ("declaration_count_below_threshold", F.col("declarations") >= least_declarations), ("country_mismatch", sure | (F.col("country_match") >= 0.5)), ("confidence_below_threshold", sure), ("taxonomy_rejected", allowed),
    ]
