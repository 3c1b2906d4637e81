"""Histories of use: the latest distinct entries, trailing counts, preferred texts, caches by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def recent(events: DataFrame, key: str, same: list[str], order: list[Column], k: int = 20) -> DataFrame:
    """Per key the ``k`` latest entries, of equal ones (by ``same``) only the latest."""
    last = events.withColumn("_r", F.row_number().over(Window.partitionBy(key, *same).orderBy(*order))).where("_r = 1").drop("_r")
    return last.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def trailing(events: DataFrame, kind: str, time: str, until: Column, days: int = 7) -> DataFrame:
    """Per kind all entries and those of the last ``days`` days."""
    return events.groupBy(kind).agg(F.count("*").alias("total"), F.count_if((F.col(time) > until - F.make_interval(days=F.lit(days))) & (F.col(time) <= until)).alias("recent"))


def preferred(uses: DataFrame, keys: list[str], text: str, used: str) -> DataFrame:
    """Per key the text used most, of equally used ones the latest, then the first by name."""
    counts = uses.groupBy(*keys, text).agg(F.count("*").alias("uses"), F.max(used).alias("last"))
    best = Window.partitionBy(*keys).orderBy(F.desc("uses"), F.desc("last"), text)
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored and new entries, of each key the latest; new ones win ties."""
    both = stored.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_n")))).where("_r = 1").drop("_r", "_n")


def sessions_cost(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages, cost to six digits and mean quality of recognition runs."""
    from customsloom.functions.numbers import round_up

    return pages.groupBy(*keys).agg(F.sum("pages").alias("pages"), round_up(F.sum("cost"), 6).alias("cost"), round_up(F.avg("quality"), 4).alias("quality"))
