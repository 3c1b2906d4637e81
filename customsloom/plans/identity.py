"""Styles, traced lines and scores of declarations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.operators import identity, scoring
from customsloom.plans.bindings import LINES, lines, table
from customsloom.plans.registry import query

_COLOURS = "black|white|navy|blue|red|green|grey|gray|beige|brown|pink|yellow|orange|purple|cream|ivory|khaki|olive|denim"
_DESCRIBED = """d AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, '1ab' || lpad(CAST(l_partkey % 50 AS VARCHAR), 8, '0') AS st, p_name, CASE l_partkey % 4 WHEN 0 THEN 'NVY' WHEN 1 THEN 'Size: xl' WHEN 2 THEN 'sz 42 HS Code - 6203.42' ELSE 'Origin - China' END AS tail, l_partkey % 3 > 0 AS styled FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(rf"""WITH {_DESCRIBED} SELECT invoice_id, position, CASE WHEN styled THEN upper(st) ELSE '' END AS style, upper(coalesce(nullif(regexp_extract(p_name, '\b({_COLOURS})\b', 1), ''), CASE tail WHEN 'NVY' THEN 'NVY' ELSE '' END)) AS colour,
  CASE tail WHEN 'Size: xl' THEN 'XL' WHEN 'sz 42 HS Code - 6203.42' THEN '42' ELSE '' END AS size FROM d""")
def line_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style, colour and size in every line's description."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    k = F.col("l_partkey")
    tail = F.when(k % 4 == 0, "NVY").when(k % 4 == 1, "Size: xl").when(k % 4 == 2, "sz 42 HS Code - 6203.42").otherwise("Origin - China")
    style = F.concat(F.lit("1ab"), F.lpad((k % 50).cast("string"), 8, "0"))
    text = F.concat_ws(" ", F.when(k % 3 > 0, style), "p_name", tail)
    rows = item.join(part, k == F.col("p_partkey")).select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position"), text.alias("description"))
    return identity.with_identity(rows).select("invoice_id", "position", "style", "colour", "size")


@query(f"""WITH {LINES}, x AS (SELECT invoice_id, position, CASE WHEN position % 3 = 0 THEN 'Transport costs' WHEN position % 5 = 0 THEN 'EUR-pallet' ELSE description END AS description, CASE WHEN invoice_id % 4 = 0 OR position % 3 = 0 THEN NULL ELSE hs_code END AS hs_code FROM lines),
  g AS (SELECT *, position % 3 = 0 AS service, position % 3 > 0 AND position % 5 > 0 AND hs_code IS NOT NULL AS good FROM x), n AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY invoice_id) AS coded FROM g)
  SELECT invoice_id, count(*) AS traced, count(hs_code) AS with_code FROM n WHERE CASE WHEN coded > 0 THEN good ELSE NOT service END GROUP BY 1""")
def traceable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of every invoice are traced: coded goods, or all but services where no line has a code."""
    p = F.col("position")
    rows = lines(spark, sf_dir).select("invoice_id", "position", F.when(p % 3 == 0, "Transport costs").when(p % 5 == 0, "EUR-pallet").otherwise(F.col("description")).alias("description"), F.when((F.col("invoice_id") % 4 != 0) & (p % 3 != 0), F.col("hs_code")).alias("hs_code"))
    return identity.traceable(rows).groupBy("invoice_id").agg(F.count("*").alias("traced"), F.count("hs_code").alias("with_code"))


_CODES = ["MISSING_GROSS_WEIGHT", "MISSING_VAT_ARTICLE", "INVOICE_DATE_IN_FUTURE", "MISSING_INCOTERMS", "DESCRIPTION_ARTIFACT", "MISSING_PACKAGE_COUNT", "NO_ORIGIN_DECLARATION"]


@query(f"""WITH i AS (SELECT DISTINCT l_orderkey AS id, {_CODES}[CAST(l_partkey % 7 + 1 AS INTEGER)] AS code, l_partkey % 7 AS c, l_partkey % 2 = 0 AS err, l_partkey % 7 IN (2, 4) AND l_suppkey % 2 = 0 AS critical FROM lineitem WHERE l_linenumber <= 2),
  k AS (SELECT id, code, max(CASE c WHEN 1 THEN 5 WHEN 6 THEN 0 WHEN 2 THEN 50 ELSE CASE WHEN err THEN 18 WHEN critical THEN 12 ELSE 3 END END) AS cost FROM i WHERE c IN (0, 1, 3, 5, 6) OR critical GROUP BY 1, 2), t AS (SELECT id, sum(cost) AS cost FROM k GROUP BY 1), a AS (SELECT id, list(DISTINCT code) AS codes FROM i GROUP BY 1),
  o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'CUSTOMS_BLOCKED' WHEN 'O' THEN 'CUSTOMS_REVIEW' ELSE 'CUSTOMS_READY' END AS status, coalesce(codes, []) AS codes, o_orderkey % 3 = 0 AS weighed, o_orderkey % 4 AS p, o_orderkey % 5 AS q, o_orderkey % 12 AS m FROM orders LEFT JOIN a ON id = o_orderkey),
  d AS (SELECT *, CASE WHEN weighed THEN 100 WHEN list_contains(codes, 'MISSING_GROSS_WEIGHT') THEN 0 ELSE 40 END AS g, CASE p WHEN 0 THEN 100 WHEN 1 THEN 90 WHEN 2 THEN 75 ELSE CASE WHEN list_contains(codes, 'MISSING_PACKAGE_COUNT') THEN 0 ELSE 30 END END AS pc, CASE WHEN q = 0 THEN 100 WHEN p = 0 THEN 60 ELSE 35 END AS pt,
    CASE WHEN q < 3 THEN 100 WHEN list_contains(codes, 'MISSING_INCOTERMS') THEN 0 ELSE 25 END AS inc, CASE WHEN q = 4 THEN 100 WHEN list_contains(codes, 'MISSING_VAT_ARTICLE') THEN 55 ELSE 70 END AS v, CASE WHEN p = 0 OR q = 1 THEN 100 WHEN p = 1 THEN 85 WHEN q = 2 THEN 45 WHEN p = 2 THEN 60 ELSE 50 END AS oe,
    CASE WHEN m = 11 THEN 50 WHEN q = 3 THEN CASE WHEN m = 0 THEN 100 ELSE 100 - m * 10 END ELSE least(CASE WHEN m = 0 THEN 100 ELSE 100 - m * 10 END, 75) END AS dc FROM o),
  b AS (SELECT id, status, floor((g * 15 + pc * 15 + pt * 10 + inc * 15 + v * 10 + oe * 20 + dc * 15) / 100.0 + 0.5) AS base FROM d), s AS (SELECT b.*, base - coalesce(cost, 0) AS raw FROM b LEFT JOIN t USING (id)),
  f AS (SELECT id, status, CAST(greatest(0, CASE status WHEN 'CUSTOMS_BLOCKED' THEN least(raw, 45) WHEN 'CUSTOMS_REVIEW' THEN least(raw, 85) ELSE raw END) AS INTEGER) AS customs_score FROM s)
  SELECT id AS invoice_id, customs_score, CASE WHEN status = 'CUSTOMS_BLOCKED' THEN 'Not ready for filing' WHEN customs_score >= 90 THEN 'Ready for export declaration' WHEN customs_score >= 75 THEN 'Mostly ready — review gaps' WHEN customs_score >= 55 THEN 'Customs review required' ELSE 'Significant gaps before filing' END AS label FROM f""")
def customs_score_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every order's declaration with its issues' penalties and its status' cap."""
    k, lp = F.col("o_orderkey"), F.col("l_partkey")
    code = F.element_at(F.array(*(F.lit(c) for c in _CODES)), (lp % 7 + 1).cast("int"))
    issues = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("invoice_id"), code.alias("code"), F.when(lp % 2 == 0, "error").otherwise("warning").alias("kind"), ((lp % 7).isin(2, 4) & (F.col("l_suppkey") % 2 == 0)).alias("critical"))
    own = issues.groupBy("invoice_id").agg(F.collect_set("code").alias("codes"))
    status = F.when(F.col("o_orderstatus") == "P", "CUSTOMS_BLOCKED").when(F.col("o_orderstatus") == "O", "CUSTOMS_REVIEW").otherwise("CUSTOMS_READY")
    rows = table(spark, sf_dir, "orders").join(own, k == F.col("invoice_id"), "left").select(k.alias("invoice_id"), status.alias("status"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), (k % 4).alias("p"), (k % 5).alias("q"), (k % 12).alias("m"))
    i, p, q, m = (F.col(c) for c in ("invoice_id", "p", "q", "m"))
    scores = scoring.customs_dimensions(
        F.when(i % 3 == 0, 5.0), F.when(p == 0, 3), F.when(p == 1, 3), F.when(p == 2, 3), F.when(q == 0, "CT"), F.when(q < 3, "EXW").otherwise("—"), F.when(q == 4, "Art. 1"), F.when(p == 0, "CONFIRMED").when(p == 2, "NOT_DECLARED"), F.when(q == 1, "DECLARED").when(q == 2, "UNVERIFIED"),
        p == 1, F.when(m < 11, m), m == 0, q == 3, F.col("codes"),
    )
    return scoring.customs_score(rows.withColumn("base", scoring.weighted(scores, scoring.READINESS_WEIGHTS)), issues)
