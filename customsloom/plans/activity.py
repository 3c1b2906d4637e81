"""Histories over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.operators import activity
from customsloom.plans.bindings import table
from customsloom.plans.registry import query

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


@query(f"""WITH e AS (SELECT *, {_K} AS k FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts DESC, event_id DESC) AS r FROM e),
  p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM l WHERE r = 1) SELECT user_id, event_type, k, event_id, place FROM p WHERE place <= 20""")
def activity_mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = activity.recent(_events(spark, sf_dir), "user_id", ["event_type", "k"], [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_type", "k", "event_id", F.col("place").cast("bigint").alias("place"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20') AS recent FROM events GROUP BY 1")
def activity_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.trailing(_events(spark, sf_dir), "event_type", "ts", F.lit("2024-01-20").cast("timestamp"))


@query(f"""WITH e AS (SELECT user_id, event_type, {_K} % 5 AS text, ts FROM events), c AS (SELECT user_id, event_type, text, count(*) AS uses, max(ts) AS last FROM e GROUP BY 1, 2, 3)
  SELECT user_id, event_type, text, uses FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY uses DESC, last DESC, text) AS r FROM c) WHERE r = 1""")
def preferred_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("text", F.col("k") % 5)
    return activity.preferred(rows, ["user_id", "event_type"], "text", "ts").select("user_id", "event_type", "text", "uses")


@query(f"""WITH e AS (SELECT *, {_K} AS k FROM events) SELECT user_id, k, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id % 2 DESC) AS r FROM e) WHERE r = 1""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "k", "event_id", "value", "ts")
    return activity.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "k"], "ts").select("user_id", "k", "event_id", "value")


@query("SELECT user_id, sum(1 + event_id % 3) AS pages, floor(sum(value / 1000) * 1000000 + 0.5) / 1000000 AS cost, floor(avg(value) * 10000 + 0.5) / 10000 AS quality FROM events GROUP BY 1")
def ocr_session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", (1 + F.col("event_id") % 3).alias("pages"), (F.col("value") / 1000).alias("cost"), F.col("value").alias("quality"))
    return activity.sessions_cost(rows, "user_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, CAST(floor(sum(value) * 100 + 0.5) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def activity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.streaming.activity import windowed

    return windowed(table(spark, sf_dir, "events"))
