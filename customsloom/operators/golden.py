"""Expected against actual results, field by field, and the summary over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from customsloom.functions.numbers import round_up


def agree(expected: Column, actual: Column, kind: str, tolerance: float = 0.02) -> Column:
    """Whether two values agree: number (within tolerance), contains, set (sorted lists equal) or normalized text; two nulls do."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c.cast("string"))), r"\s+", " ")
    if kind == "number":
        same = F.abs(expected - actual) <= tolerance
    elif kind == "contains":
        same = norm(actual).contains(norm(expected))
    elif kind == "set":
        same = F.array_sort(expected) == F.array_sort(actual)
    else:
        same = norm(expected) == norm(actual)
    return F.coalesce(same, expected.isNull() & actual.isNull())


def compare(expected: DataFrame, actual: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Rows (key, field) that differ; expected cases without a result differ in MISSING_RESULT.  ``fields`` gives each field's kind, or number:tolerance."""
    e, a = expected.select(key, *(F.col(f).alias(f"e_{f}") for f in fields)), actual.select(key, *(F.col(f).alias(f"a_{f}") for f in fields), F.lit(True).alias("_there"))
    both = e.join(a, key, "left")
    tests = []
    for f, kind in fields.items():
        name, _, tolerance = kind.partition(":")
        tests.append(F.when(F.col("_there") & ~agree(F.col(f"e_{f}"), F.col(f"a_{f}"), name, float(tolerance or 0.02)), f))
    found = F.array_compact(F.array(*tests, F.when(F.col("_there").isNull(), "MISSING_RESULT")))
    return both.select(key, F.explode(found).alias("field"))


def without_allowed(differences: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return differences.join(allowed, [key, "field"], "left_anti")


def summary(cases: DataFrame, differences: DataFrame, key: str) -> DataFrame:
    """One row: cases, passed, pass rate, and readiness: 0.4 pass rate, 0.35 mean accuracy, 0.25 share of right readiness.

    ``cases`` has the key, accuracy (0 to 100) and readiness_ok.
    """
    failed = differences.select(key).distinct().withColumn("_failed", F.lit(True))
    rows = cases.join(failed, key, "left")
    out = rows.agg(F.count("*").alias("total"), F.count_if(F.col("_failed").isNull()).alias("passed"), F.avg("accuracy").alias("a"), F.avg(F.col("readiness_ok").cast("double")).alias("r"))
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(1.0)
    return out.select("total", "passed", round_up(rate * 100, 2).alias("pass_rate"), round_up(F.coalesce("a", F.lit(100.0)), 2).alias("avg_accuracy"), round_up((rate * 0.4 + F.coalesce("a", F.lit(100.0)) / 100 * 0.35 + F.coalesce("r", F.lit(1.0)) * 0.25) * 100, 1).alias("production_readiness"))


def defects(differences: DataFrame, key: str, most: int = 20) -> DataFrame:
    """Per field the number of cases, and the first few of their keys."""
    return differences.groupBy("field").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col(key))), 1, most), ",").alias("cases"))


def accuracy(rows: DataFrame, category: str, correct: Column, baseline: Column) -> DataFrame:
    """Per category and in total (category null): cases, shares right with and without, improved and regressed."""
    return rows.rollup(category).agg(
        F.count("*").alias("n"), round_up(F.avg(correct.cast("double")), 4).alias("accuracy"), round_up(F.avg(baseline.cast("double")), 4).alias("baseline_accuracy"), F.count_if(correct & ~baseline).alias("improved"), F.count_if(~correct & baseline).alias("regressed")
    )


def live_summary(cases: DataFrame) -> DataFrame:
    """One row of cases (success, confidence, error, used, candidates, injected, won): counts, success rate, mean confidence of successes, and rates to four digits; 0 without cases."""
    rate = lambda c: F.coalesce(round_up(F.try_divide(F.count_if(F.coalesce(F.col(c), F.lit(False))).cast("double"), F.count("*")), 4), F.lit(0.0))
    return cases.agg(
        F.count("*").alias("total_cases"), F.count_if(F.coalesce(F.col("error") != "", F.lit(False))).alias("errors"), rate("success").alias("success_rate"),
        F.coalesce(round_up(F.avg(F.when(F.col("success"), F.col("confidence"))), 4), F.lit(0.0)).alias("average_confidence"), *(rate(c).alias(f"{c}_rate") for c in ("used", "candidates", "injected", "won")),
    )
