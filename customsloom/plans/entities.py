"""Entities in texts made from parts' names, makers and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from customsloom.operators import entities
from customsloom.plans.bindings import table
from customsloom.plans.matching import _values
from customsloom.plans.registry import query

#: kind, value, phrase, whole word, rank.
DICTIONARY = [
    ("vehicle_brand", "man", "man", True, 1), ("vehicle_brand", "daf", "daf", True, 0), ("brand", "brand12", "brand12", True, 0), ("brand", "brand3x", "brand3", False, 1), ("brand", "ring & co", "ring", True, 2),
    ("condition", "used", "old", True, 1), ("condition", "new", "small", True, 0), ("vehicle", "goods_vehicle", "large gear", False, 0), ("vehicle", "trailer", "hot plate", False, 1), ("vehicle", "trailer", "hot", False, 1),
    ("family", "sensor", "steel", False, 2), ("family", "rings", "blue ring", False, 0), ("family", "rings", "ring", False, 0), ("family", "ring_steel", "ring steel", False, 1), ("family", "ups", "promo", True, 3), ("family", "widgets", "widget", False, 4), ("family", "gets", "get", False, 5),
]
PROFILES = [("goods_vehicle", ["87"], ["8704"], ["truck"]), ("trailer", ["87"], ["8716"], ["trailer", "semi"]), ("sensor", ["90"], ["9026", "9031"], ["sensor"]), ("rings", ["71"], ["7113"], ["ring"]), ("ups", ["85"], ["8504"], ["ups", "sensor"])]
IMPLIED = [("man", "goods_vehicle"), ("daf", "goods_vehicle")]
PENALISED = [("8543", ("ups", "sensor")), ("9026", ("rings",))]
NEVER = ("x1",)

_TEXT = """p_name || ' ' || replace(p_brand, '#', '') || ' ' || lower(split_part(p_type, ' ', 1)) || CASE p_partkey % 7 WHEN 0 THEN ' MAN TGX 18.440' WHEN 1 THEN ' daf 2019' WHEN 2 THEN ' PN-' || p_partkey WHEN 3 THEN ' 6es7' || p_partkey || ' plc' WHEN 4 THEN ' mantle AB' || (1000 + p_partkey % 9000) ELSE '' END"""
_DICTIONARY = _values([(k, v, p, int(w), r) for k, v, p, w, r in DICTIONARY], "kind, value, phrase, whole, rank")
_SPANS = rf"""p AS (SELECT p_partkey AS id, {_TEXT} AS text FROM part), d AS (SELECT * FROM {_DICTIONARY}), c AS (SELECT id, lower(text) AS t, unnest(generate_series(1, length(text))) AS i FROM p),
  f AS (SELECT DISTINCT id, kind, value, CAST(i - 1 AS INTEGER) AS s, CAST(i - 1 + length(phrase) AS INTEGER) AS e, rank FROM c JOIN d ON substr(t, i, length(phrase)) = phrase
    AND (whole = 0 OR NOT (regexp_matches(substr(t, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[a-z0-9_]') OR regexp_matches(substr(t, i + length(phrase), 1), '[a-z0-9_]')))),
  l AS (SELECT id, kind, list([{{'s': s, 'e': e, 'v': value, 'r': rank}}] ORDER BY s, e DESC, rank, value) AS xs FROM f GROUP BY 1, 2),
  r AS (SELECT id, kind, unnest(list_reduce(xs, lambda a, b: CASE WHEN b[1].s >= a[-1].e THEN a || b ELSE a END)) AS x FROM l),
  sp AS (SELECT id, kind, x.v AS value, x.s AS start, x.e AS stop, x.r AS rank FROM r)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    extra = F.when(k % 7 == 0, " MAN TGX 18.440").when(k % 7 == 1, " daf 2019").when(k % 7 == 2, F.concat(F.lit(" PN-"), key)).when(k % 7 == 3, F.concat(F.lit(" 6es7"), key, F.lit(" plc"))).when(k % 7 == 4, F.concat(F.lit(" mantle AB"), (1000 + k % 9000).cast("string"))).otherwise("")
    text = F.concat("p_name", F.lit(" "), F.regexp_replace("p_brand", "#", ""), F.lit(" "), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), extra)
    return table(spark, sf_dir, "part").select(k.alias("id"), text.alias("text"))


def _dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "kind string, value string, phrase string, whole boolean, rank int")


@query(f"WITH {_SPANS} SELECT id, kind, value, start, stop, row_number() OVER (PARTITION BY id ORDER BY start, stop, kind, value) AS n FROM sp")
def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every find of the dictionary in every part's text, overlaps resolved by kind."""
    found = entities.flat_spans(entities.spans(_texts(spark, sf_dir), _dictionary(spark)))
    return found.withColumn("n", F.col("n").cast("bigint"))


def _joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def _of(kind: str) -> str:
    return f"coalesce((SELECT string_agg(value, '|' ORDER BY rank, value) FROM (SELECT DISTINCT value, rank FROM sp WHERE sp.id = p.id AND kind = '{kind}')), '')"


_PATTERNS = [f"(?i){p}" for p in entities.VEHICLE_MODELS] + entities.INDUSTRIAL_MODELS
_MODELS = " || ".join(f"list_transform(regexp_extract_all(text, '{p}'), lambda x: trim(x))" for p in _PATTERNS)


@query(f"""WITH {_SPANS}, e AS (SELECT id, text, {_of("vehicle_brand")} AS makes, {_of("brand")} AS others, {_of("condition")} AS conditions, {_of("vehicle")} AS named, {_of("family")} AS families, {_MODELS} AS found FROM p),
  u AS (SELECT *, CASE WHEN named = '' AND makes <> '' THEN 'goods_vehicle' ELSE named END AS vehicles, concat_ws('|', nullif(makes, ''), nullif(others, '')) AS brands,
    list_filter(found, lambda x, i: list_position(list_transform(found, lambda y: lower(y)), lower(x)) = i) AS models FROM e),
  w AS (SELECT *, vehicles <> '' OR makes <> '' AS is_vehicle, '|' || families || '|' AS fs, lower(text) AS low, list_distinct(string_split(vehicles, '|') || string_split(families, '|')) AS vals FROM u),
  x AS (SELECT *, contains(fs, '|sensor|') AS se, contains(fs, '|ups|') AS au, others <> '' AND regexp_matches(low, '\\b(sensor|senzor|transducer|transmitter|plc|automation)\\b') AS un FROM w)
  SELECT id, brands, vehicles, families, split_part(conditions, '|', 1) AS condition, array_to_string(models, '|') AS models,
    array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(models, lambda m: regexp_extract_all(lower(m), '[a-z0-9]+'))), lambda t: regexp_full_match(t, '[0-9]{{2,}}|[a-z]{{2,5}}') OR t = 'x1')
      || list_filter(flatten(list_transform(string_split(brands, '|'), lambda b: string_split_regex(lower(b), '[\\s+/&]+'))), lambda t: length(t) >= 3) || CASE WHEN is_vehicle THEN regexp_extract_all(text, '\\b\\d{{3,4}}\\b') ELSE [] END)), '|') AS excluded,
    is_vehicle, se OR (NOT se AND NOT au AND un AND regexp_matches(low, '\\b(sensor|senzor)\\b')) AS is_sensor, au OR (NOT se AND NOT au AND un AND regexp_matches(low, '\\b(plc|automation|controller)\\b')) AS is_automation,
    concat_ws('|', CASE WHEN se OR au THEN '8543' END, CASE WHEN contains(fs, '|rings|') THEN '9026' END) AS penalised,
    coalesce((SELECT string_agg(DISTINCT c, '|' ORDER BY c) FROM {_values([(v, c) for v, cs, _, _ in PROFILES for c in cs], "v, c")} WHERE list_contains(vals, v)), '') AS chapters,
    coalesce((SELECT string_agg(DISTINCT c, '|' ORDER BY c) FROM {_values([(v, c) for v, _, cs, _ in PROFILES for c in cs], "v, c")} WHERE list_contains(vals, v)), '') AS headings,
    coalesce((SELECT string_agg(DISTINCT c, '|' ORDER BY c) FROM {_values([(v, c) for v, _, _, cs in PROFILES for c in cs], "v, c")} WHERE list_contains(vals, v)), '') AS terms FROM x""".replace("\\\\", "\\"))
def product_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, types, families, condition, models, excluded words and hints of every part's text."""
    profiles = spark.createDataFrame(PROFILES, "value string, chapters array<string>, headings array<string>, terms array<string>")
    found = entities.entities(_texts(spark, sf_dir), _dictionary(spark), profiles, spark.createDataFrame(IMPLIED, "brand string, vehicle string"), never_rank=NEVER, penalised=PENALISED)
    arrays = ["brands", "vehicles", "families", "models", "excluded", "penalised", "chapters", "headings", "terms"]
    return found.select("id", *(_joined(c) for c in arrays), F.coalesce("condition", F.lit("")).alias("condition"), "is_vehicle", "is_sensor", "is_automation")
