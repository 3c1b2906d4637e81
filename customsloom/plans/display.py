"""Hierarchies, attributes and reasons over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.operators import attributes, hierarchy, provenance
from customsloom.plans.bindings import table
from customsloom.plans.registry import query

_PARENT = "CASE WHEN p_partkey % 499 = 7 THEN p_partkey WHEN p_partkey % 499 = 8 THEN p_partkey + 1 WHEN p_partkey % 499 = 9 THEN p_partkey - 1 WHEN p_partkey % 97 = 0 THEN -p_partkey WHEN p_partkey > 2 THEN p_partkey // 2 END"
_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'Of cotton' WHEN 2 THEN p_name || ' (' || p_type || ')' ELSE 'Parts and accessories of ' || p_name END"
_TREE = f"""n AS (SELECT p_partkey AS code, {_PARENT} AS parent, {_TITLE} AS title FROM part),
  t AS (SELECT code, CASE WHEN parent IS NULL THEN 'ok' ELSE 'orphan' END AS status, 1 AS depth, [title] AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT code FROM n)
    UNION ALL SELECT n.code, t.status, t.depth + 1, list_append(t.path, n.title) FROM t JOIN n ON n.parent = t.code)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parent = F.when(k % 499 == 7, k).when(k % 499 == 8, k + 1).when(k % 499 == 9, k - 1).when(k % 97 == 0, -k).when(k > 2, F.floor(k / 2))
    title = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, "Of cotton").when(k % 4 == 2, F.format_string("%s (%s)", "p_name", "p_type")).otherwise(F.concat(F.lit("Parts and accessories of "), "p_name"))
    return table(spark, sf_dir, "part").select(k.alias("code"), parent.cast("bigint").alias("parent"), title.alias("title"))


@query(f"WITH RECURSIVE {_TREE} SELECT n.code, coalesce(status, 'cycle') AS status, coalesce(depth, 0) AS depth, coalesce(array_to_string(path, ' > '), '') AS path FROM n LEFT JOIN t USING (code)")
def hierarchy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of every part to the root of a tree of parts, with orphans, loops and what hangs below them."""
    found = hierarchy.paths(_nodes(spark, sf_dir))
    return found.select("code", "status", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce(F.array_join("path", " > "), F.lit("")).alias("path"))


_MATERIAL = hierarchy.MATERIAL.replace("'", "''")
_GENERIC = ", ".join(f"'{x}'" for x in hierarchy.GENERIC)
_IS = f"(x = '' OR regexp_matches(x, '{_MATERIAL}') OR (lower(x) IN ({_GENERIC}) AND length(x) < 28))"
_FIRST = "list_filter({0}, lambda x: {1})"


def _longest(xs: str) -> str:
    return f"list_reduce({xs}, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END)"


@query(f"""WITH RECURSIVE {_TREE}, k AS (SELECT code, path, path[-1] AS own, list_filter(path, lambda x: (NOT {_IS} OR x = path[-1]) AND NOT (code % 3 = 0 AND contains(lower(x), 'steel')) AND length(x) >= 18) AS kept, list_filter(path, lambda x: NOT {_IS}) AS solid FROM t),
  f AS (SELECT *, CASE WHEN code % 3 = 0 THEN list_filter(kept, lambda x: contains(lower(x), 'ring')) ELSE [] END AS liked, list_filter(solid, lambda x: length(x) >= 40 OR (contains(x, '(') AND length(x) >= 24)) AS long, list_filter(solid, lambda x: length(x) >= 22) AS mid FROM k),
  h AS (SELECT *, coalesce(CASE WHEN len(liked) > 0 THEN {_longest("liked")} WHEN len(kept) > 0 THEN {_longest("kept")} END, CASE WHEN len(long) > 0 THEN {_longest("long")} WHEN len(mid) > 0 THEN {_longest("mid")} END, path[1]) AS heading FROM f)
  SELECT code, heading, CASE WHEN contains(lower(heading), lower(own)) THEN heading WHEN {_IS.replace("x", "own").replace("own", "own")} THEN CASE WHEN contains(lower(heading), replace(lower(own), 'of ', '')) THEN heading ELSE heading || ', ' || lower(own) END ELSE heading || ': ' || own END AS combined FROM h""".replace(_IS.replace("x", "own"), _IS.replace("(x ", "(own ").replace("(x,", "(own,").replace("(x)", "(own)")))
def hierarchy_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that fits a part's path best, and the description shown: every third part is of a family that prefers rings and avoids steel."""
    rows = hierarchy.paths(_nodes(spark, sf_dir)).where("path IS NOT NULL")
    families = F.when(F.col("code") % 3 == 0, F.array(F.lit("rings"), F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
    title = hierarchy.heading(F.col("path"), hierarchy.family_terms(families, {"rings": ("ring",)}), hierarchy.family_terms(families, {"rings": ("Steel",)}))
    return rows.withColumn("heading", title).select("code", "heading", hierarchy.combined(F.col("heading"), F.element_at("path", -1), F.col("path")).alias("combined"))


_WORDS = ["mens cotton trousers", "ženske bombaž sweater", "ladies jersey", "boys denim jeans", "plain goods", "knit wool for girls"]


@query(rf"""WITH c AS (SELECT conv_id, turn, role, (conv_id * 3 + turn) % 6 AS k, (conv_id * 7 + turn * 5) % 100 / 100.0::DOUBLE AS conf, ['mens cotton trousers', 'ženske bombaž sweater', 'ladies jersey', 'boys denim jeans', 'plain goods', 'knit wool for girls'][CAST((conv_id * 3 + turn) % 6 + 1 AS INTEGER)] AS t FROM conversations),
  d AS (SELECT *, CASE k WHEN 0 THEN 'mens' WHEN 3 THEN 'mens' WHEN 1 THEN 'womens' WHEN 2 THEN 'womens' WHEN 5 THEN 'womens' END AS dg, CASE k WHEN 0 THEN 'woven' WHEN 3 THEN 'woven' WHEN 1 THEN 'knitted' WHEN 5 THEN 'knitted' END AS dc,
    CASE WHEN role = 'user' THEN CASE turn % 3 WHEN 0 THEN 'mens' WHEN 1 THEN 'womens' END END AS ug, CASE WHEN conf >= {attributes.AUTOMATIC} THEN 'knitted' END AS ac, CASE WHEN conf >= {attributes.AUTOMATIC} THEN 'womens' END AS ag FROM c)
  SELECT conv_id, turn, coalesce(ug, ag, dg, '') AS gender, CASE WHEN ug IS NOT NULL THEN 'user' WHEN ag IS NOT NULL THEN 'automatic' WHEN dg IS NOT NULL THEN 'detected' ELSE '' END AS gender_by,
    concat_ws(',', CASE WHEN ug IS NOT NULL AND ag <> ug THEN 'automatic' END, CASE WHEN coalesce(ug, ag) <> dg THEN 'detected' END) AS gender_against, coalesce(ac, dc, '') AS construction, CASE WHEN ac IS NOT NULL THEN 'automatic' WHEN dc IS NOT NULL THEN 'detected' ELSE '' END AS construction_by FROM d""")
def disambiguation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of every turn: the user's, automatic ones above the threshold, and what a description shows."""
    c, t = F.col("conv_id"), F.col("turn")
    text = F.element_at(F.array(*(F.lit(w) for w in _WORDS)), ((c * 3 + t) % 6 + 1).cast("int"))
    user = F.when(F.col("role") == "user", F.when(t % 3 == 2, F.create_map(F.lit("apparel_gender"), F.lit(" "))).otherwise(F.create_map(F.lit("apparel_gender"), F.when(t % 3 == 0, "mens").otherwise("womens"))))
    automatic = F.create_map(F.lit("apparel_gender"), F.lit("womens"), F.lit("textile_construction"), F.lit("knitted"))
    merged = attributes.merge([attributes.Source("user", user), attributes.Source("automatic", automatic, ((c * 7 + t * 5) % 100) / 100.0, attributes.AUTOMATIC), attributes.Source("detected", attributes.answers(attributes.detect(text)))])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", merged.alias("m"))
    at = lambda q, f: F.coalesce(F.try_element_at("m", F.lit(q))[f], F.lit(""))
    against = F.coalesce(F.array_join(F.try_element_at("m", F.lit("apparel_gender"))["against"], ","), F.lit(""))
    return rows.select("conv_id", "turn", at("apparel_gender", "answer").alias("gender"), at("apparel_gender", "source").alias("gender_by"), against.alias("gender_against"), at("textile_construction", "answer").alias("construction"), at("textile_construction", "source").alias("construction_by"))


@query("""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS ord, CAST(l_quantity AS INTEGER) % 6 AS declarations, (l_partkey % 100) / 100.0::DOUBLE AS confidence, (l_suppkey % 4) / 4.0::DOUBLE AS country_match, l_partkey % 5 > 0 AS ok FROM lineitem WHERE l_linenumber > 1),
  r AS (SELECT *, CASE WHEN declarations < 2 THEN 0 WHEN confidence < 0.55 AND country_match < 0.5 THEN 1 WHEN confidence < 0.55 THEN 2 WHEN NOT ok THEN 3 ELSE 4 END AS stage FROM c),
  n AS (SELECT r.*, ['declaration_count_below_threshold', 'country_mismatch', 'confidence_below_threshold', 'taxonomy_rejected', 'kept'][stage + 1] AS reason FROM r), s AS (SELECT id, count(*) AS candidates, count(*) FILTER (stage = 4) AS kept, max(stage) AS top FROM n GROUP BY 1),
  b AS (SELECT id, max(confidence) AS best FROM n JOIN s USING (id) WHERE stage = top GROUP BY 1), m AS (SELECT id, string_agg(reason || '=' || k, ',' ORDER BY reason) AS by_reason FROM (SELECT id, reason, count(*) AS k FROM n GROUP BY 1, 2) GROUP BY 1)
  SELECT o_orderkey AS id, coalesce(candidates, 0) AS candidates, coalesce(kept, 0) AS kept, coalesce(['declaration_count_below_threshold', 'country_mismatch', 'confidence_below_threshold', 'taxonomy_rejected', 'kept'][top + 1], 'no_fts_match') AS reason, coalesce(by_reason, '') AS by_reason, best FROM orders LEFT JOIN s ON id = o_orderkey LEFT JOIN b USING (id) LEFT JOIN m USING (id)""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an order's candidates (its lines after the first) weren't used."""
    item = table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    rows = item.select(F.col("l_orderkey").alias("id"), (F.col("l_quantity").cast("int") % 6).alias("declarations"), ((F.col("l_partkey") % 100) / 100.0).alias("confidence"), ((F.col("l_suppkey") % 4) / 4.0).alias("country_match"), (F.col("l_partkey") % 5 > 0).alias("ok"))
    traced = provenance.traced(rows, provenance.knowledge_filters(2, 0.55, F.col("ok")))
    found = provenance.reasons(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), traced, "id", [F.col("confidence")])
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("by_reason")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select("id", "candidates", "kept", "reason", F.coalesce(shown, F.lit("")).alias("by_reason"), F.col("best0").alias("best"))
