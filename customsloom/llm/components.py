"""Connected components of a link table, by alternating large and small stars; nothing is collected but a change count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from customsloom.llm.common import discard, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that a chain of links reaches.  Nodes without a link to another don't occur.

    Each round gives every node's neighbours its least one (a grouped minimum with a map-side part, joined back, so that Spark can
    split a node with many links); rounds grow with the logarithm of the longest chain.  Nulls and links of a node with itself
    count for nothing.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges, before = written(edges, "edges"), None

    def with_least(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), F.col("u") == F.col("w")).drop("w")

    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
        small = with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        old, edges = edges, written(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        discard(old, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
