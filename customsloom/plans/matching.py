"""Families, rules, candidates and codes in texts made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.functions import text as texts_
from customsloom.operators import codes, matching, mining, ranking, tuning
from customsloom.operators.matching import Rule
from customsloom.plans.bindings import code_of, table
from customsloom.plans.registry import query

_CODE = "lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 6, '0')"


def _values(rows: list[tuple], names: str) -> str:
    shown = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") v({names})"


TAXONOMY = [("rings", "ring"), ("rings", "large ring"), ("small_goods", "small"), ("steel", "cold steel"), ("widgets", "red widget"), ("bolts", "bolt"), ("parts", "idge"), ("plates", "hot plate"), ("promo", "promo"), ("anodized", "anodized t")]


@query(f"""WITH p AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS t FROM part), x AS (SELECT * FROM {_values(TAXONOMY, 'family, phrase')}), l AS (SELECT family, max(length(phrase)) AS n FROM x GROUP BY 1),
  f AS (SELECT DISTINCT id, family FROM p JOIN x ON CASE WHEN length(phrase) <= 5 AND NOT contains(phrase, ' ') THEN regexp_matches(t, '\\b' || phrase || '\\b') ELSE contains(t, phrase) END)
  SELECT id, family, row_number() OVER (PARTITION BY id ORDER BY n DESC, family) AS place FROM f JOIN l USING (family)""")
def family_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    found = matching.families(rows, spark.createDataFrame(TAXONOMY, "family string, phrase string"))
    return found.withColumn("place", F.col("place").cast("bigint"))


RULES = [
    Rule("ring_goods", required=("ring",), any_of=("red", "blue"), families=("rings", "jewels"), excluded_chapters=("87",), enrichment="finger ring"),
    Rule("hot_plate", required=("plate",), context=("hot", "very hot"), anti=("steel",), families=("heaters",), penalised_headings=("8516",), enrichment="heating plate"),
    Rule("gear_wheel", any_of=("gear", "red nut"), anti_context={"large": ("green", "cold")}, families=("gears", "rings")),
    Rule("cold_trade", patterns=(r"^cold\s", r"\bsmall blue\b"), families=("cold",), excluded_chapters=("02", "87"), enrichment="finger ring"),
]


@query(r"""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS t, p_name FROM part), w AS (SELECT *, string_split(t, ' ') AS w FROM p),
  h AS (SELECT id, p_name, t, list_contains(w, 'ring') AND (list_contains(w, 'red') OR list_contains(w, 'blue')) AS a, list_contains(w, 'plate') AND list_contains(w, 'hot') AND NOT list_contains(w, 'steel') AS b,
    (list_contains(w, 'gear') OR contains(t, 'red nut')) AND NOT (list_contains(w, 'large') AND (list_contains(w, 'green') OR list_contains(w, 'cold'))) AS c, regexp_matches(t, '^cold\s|\bsmall blue\b') AS d FROM w),
  x AS (SELECT *, concat_ws(' ', CASE WHEN a OR d THEN 'finger ring' END, CASE WHEN b THEN 'heating plate' END) AS e FROM h)
  SELECT id, concat_ws(',', CASE WHEN a THEN 'ring_goods' END, CASE WHEN b THEN 'hot_plate' END, CASE WHEN c THEN 'gear_wheel' END, CASE WHEN d THEN 'cold_trade' END) AS rules,
    concat_ws(',', CASE WHEN a THEN 'rings,jewels' END, CASE WHEN b THEN 'heaters' END, CASE WHEN c THEN CASE WHEN a THEN 'gears' ELSE 'gears,rings' END END, CASE WHEN d THEN 'cold' END) AS families,
    concat_ws(',', CASE WHEN a THEN '87' END, CASE WHEN d THEN CASE WHEN a THEN '02' ELSE '02,87' END END) AS excluded_chapters, CASE WHEN b THEN '8516' ELSE '' END AS penalised_headings,
    CASE WHEN e = '' THEN p_name WHEN a AND NOT d AND b THEN p_name || ' finger ring heating plate' WHEN d AND NOT a AND b THEN p_name || ' heating plate finger ring' ELSE p_name || ' ' || e END AS enriched FROM x""")
def rule_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.recognise(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), RULES, "p_name")
    return rows.select("id", *(F.array_join(c, ",").alias(c) for c in ("rules", "families", "excluded_chapters", "penalised_headings")), "enriched")


SERIES = [("sensor", ("brand12", "Brand34"), r"\bPN\d*5\b"), ("valve", ("brand11", "brand12"), r"\bpn1\d*\b"), ("sensor", ("brand21",), r"\bPN\d+\b")]


@query(r"""WITH p AS (SELECT p_partkey AS id, lower(replace(p_brand, '#', '')) AS b, 'pn' || p_partkey AS m FROM part),
  h AS (SELECT id, (b IN ('brand12', 'brand34') AND regexp_matches(m, '^pn\d*5$')) OR b = 'brand21' AS s, b IN ('brand11', 'brand12') AND regexp_matches(m, '^pn1\d*$') AS v, b = 'brand21' AS late FROM p)
  SELECT id, concat_ws(',', CASE WHEN s THEN 'sensor' END, CASE WHEN v THEN 'valve' END) AS families FROM h""")
def maker_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.regexp_replace("p_brand", "#", ""), F.lit(" model PN"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(matching.series(text, SERIES), ",").alias("families"))


@query(f"""WITH p AS (SELECT p_partkey AS id, {_CODE} AS c FROM part), n AS (SELECT DISTINCT c AS key FROM p WHERE id % 3 <> 0), w AS (SELECT id, CASE id % 4 WHEN 0 THEN c || '90' WHEN 1 THEN substr(c, 1, 6) WHEN 2 THEN substr(c, 1, 6) || '99' ELSE c END AS code FROM p),
  x AS (SELECT w.id, 10 AS width, min(key) AS key FROM w JOIN n ON length(code) >= 10 AND length(key) >= 10 AND substr(code, 1, 10) = substr(key, 1, 10) GROUP BY 1 UNION ALL SELECT w.id, 8, min(key) FROM w JOIN n ON length(code) >= 8 AND substr(code, 1, 8) = substr(key, 1, 8) GROUP BY 1
    UNION ALL SELECT w.id, 6, min(key) FROM w JOIN n ON substr(code, 1, 6) = substr(key, 1, 6) GROUP BY 1), b AS (SELECT id, max(width) AS width, arg_max(key, width) AS key FROM x GROUP BY 1)
  SELECT w.id, b.width, b.key, 'text ' || b.key AS value, l.key AS point FROM w LEFT JOIN b USING (id) LEFT JOIN n l ON length(code) >= 8 AND substr(code, 1, 8) = l.key""")
def nomenclature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a code's longest prefix, and that of its first eight digits."""
    c, k = code_of(F.col("p_size"), F.col("p_partkey")), F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    known = part.where(k % 3 != 0).select(c.alias("cn_digits")).distinct().withColumn("description", F.concat(F.lit("text "), "cn_digits"))
    code = F.when(k % 4 == 0, F.concat(c, F.lit("90"))).when(k % 4 == 1, F.substring(c, 1, 6)).when(k % 4 == 2, F.concat(F.substring(c, 1, 6), F.lit("99"))).otherwise(c)
    rows = part.select(k.alias("id"), code.alias("code"))
    point = matching.lookup(rows, known, "code").select("id", F.col("cn_digits").alias("point"))
    return matching.longest_prefix_record(rows, known, "id", "code").join(point, "id")


_FAMILIES = ["ups", "proximity_sensor", "electric_motor", "furniture_cabinet", "stationery_pen", "food_pasta", "frequency_inverter", "power_supply", "other"]
_HEADINGS = ["8543", "8536", "9026", "8708", "9402", "2106", "8504", "9608", "0402"]
_SAYS = ["battery clamp", "inductive proximity switch", "dental chair", "refills for ballpoint pens", "diesel engine", "exceeding 500 kva", "plain"]


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""WITH p AS (SELECT p_partkey AS id, {_list(_FAMILIES)}[CAST(p_partkey % 9 + 1 AS INTEGER)] AS f, {_list(_HEADINGS)}[CAST((p_partkey // 9) % 9 + 1 AS INTEGER)] AS h, {_list(_SAYS)}[CAST((p_partkey // 81) % 7 + 1 AS INTEGER)] AS t FROM part), x AS (SELECT *, substr(h, 1, 2) AS c FROM p)
  SELECT id, CASE f WHEN 'ups' THEN h = '8543' OR (h = '8536' AND t = 'battery clamp') OR (h = '8504' AND t = 'exceeding 500 kva') WHEN 'proximity_sensor' THEN h = '9026' AND t <> 'inductive proximity switch' WHEN 'electric_motor' THEN c = '87' WHEN 'furniture_cabinet' THEN h = '9402' AND t = 'dental chair'
      WHEN 'stationery_pen' THEN t = 'refills for ballpoint pens' WHEN 'food_pasta' THEN h IN ('2106', '0402') WHEN 'frequency_inverter' THEN t = 'diesel engine' AND h <> '8504' WHEN 'power_supply' THEN h = '8504' AND t = 'exceeding 500 kva' ELSE false END AS misleading,
    CASE id % 3 WHEN 0 THEN c IN ('85', '90') WHEN 1 THEN c <> '85' ELSE true END AS chapter_allowed,
    CASE WHEN h = '8708' THEN false WHEN id % 2 = 0 AND h IN ('8536', '9402') THEN true WHEN id % 2 = 0 AND id % 4 = 0 THEN false ELSE c IN ('85', '94', '87') END AS in_space, id % 360 - 180 BETWEEN -90 AND 90 AND id % 7 >= 1 AS in_range FROM x""")
def candidate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives of families, chapters, the family's space and possible figures."""
    k = F.col("p_partkey")
    pick = lambda xs, n: F.get(F.array(*(F.lit(x) for x in xs)), (n % len(xs)).cast("int"))
    strings = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), pick(_FAMILIES, k).alias("f"), pick(_HEADINGS, F.floor(k / 9)).alias("h"), pick(_SAYS, F.floor(k / 81)).alias("t"))
    i, c = F.col("id"), F.substring("h", 1, 2)
    allowed, excluded = F.when(i % 3 == 0, strings("85", "90")).otherwise(strings()), F.when(i % 3 == 1, strings("85")).otherwise(strings())
    priors = F.when(i % 2 == 0, strings("8536", "9402")).otherwise(strings())
    return rows.select(
        "id", matching.misleading(F.array("f"), F.col("h"), F.col("t")).alias("misleading"), matching.chapter_allowed(c, allowed, excluded).alias("chapter_allowed"),
        matching.in_family_space(c, F.col("h"), strings("8708"), priors, strings("85", "94", "87"), i % 4 == 0).alias("in_space"), ((i % 360 - 180).between(-90, 90) & (i % 7 >= 1)).alias("in_range"),
    )


@query(f"""WITH n AS (SELECT {_CODE} AS cn8, min(lower(p_name)) AS t FROM part GROUP BY 1), a AS (SELECT c_custkey AS query_id, unnest([{{'ord': 1, 'token': split_part('mall idget late crew teel', ' ', CAST(c_custkey % 5 + 1 AS INTEGER))}}, {{'ord': 2, 'token': 'nut'}}, {{'ord': 3, 'token': split_part('arge green', ' ', CAST(c_custkey % 2 + 1 AS INTEGER))}}], recursive := true) FROM customer WHERE c_custkey <= 200),
  h AS (SELECT DISTINCT query_id, cn8 FROM a JOIN n ON length(token) >= 4 AND contains(t, token)) SELECT query_id, cn8, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cn8) AS place FROM h) WHERE place <= 15""")
def like_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of words anywhere in a record, for those whom the full text doesn't serve; the first 200 customers ask (the list of queries)."""
    k = F.col("c_custkey")
    pick = lambda words: F.get(F.split(F.lit(words), " "), (k % len(words.split())).cast("int"))
    asked = table(spark, sf_dir, "customer").where(k <= 200).select(k.alias("query_id"), F.posexplode(F.array(pick("mall idget late crew teel"), F.lit("nut"), pick("arge green"))).alias("ord", "token"))
    known = table(spark, sf_dir, "part").groupBy(code_of(F.col("p_size"), F.col("p_partkey")).alias("cn8")).agg(F.min(F.lower("p_name")).alias("text"))
    return matching.like_search(asked, known, 15).withColumn("place", F.col("place").cast("bigint"))


_TEXTS = ["HS code: 8523.51.10", "12 73181590 m steel", "Tel 12345678 and code 391O1000", "nothing here", "pos 7 of 9403.60.10 wood\n8 wood 94036010"]
_HITS = [(0, None, "85235110", "labelled", 0.92), (1, 12, "73181590", "table", 0.97), (1, None, "73181590", "bare", 0.7), (2, None, "12345678", "bare", 0.7), (2, None, "39101000", "bare", 0.7), (4, None, "94036010", "dotted", 0.9), (4, 7, "94036010", "position", 0.85), (4, 8, "94036010", "position", 0.85)]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.get(F.array(*(F.lit(t) for t in _TEXTS)), (k % 5).cast("int")).alias("text"))


@query(f"SELECT o_orderkey AS id, CAST(position AS INTEGER) AS position, code, source, CAST(confidence AS DOUBLE) AS confidence FROM orders JOIN {_values(_HITS, 'm, position, code, source, confidence')} ON o_orderkey % 5 = m")
def code_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.hits(_documents(spark, sf_dir))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '85235110' WHEN 1 THEN '73181590' WHEN 4 THEN '94036010' END AS code, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN '73181590' ELSE '39201010' END AS uniform
  FROM orders WHERE o_orderkey % 5 IN (0, 1, 4)""")
def document_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name one code, beside the code that most of their lines share."""
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, "a 73181590 b 73181590 c 39201010 d 73181590").otherwise("39201010 then 3920.10.10 and 39201010, 39201010 once more, 73181590")
    lines = table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text"), F.when(k % 3 == 0, 5).otherwise(3).alias("lines"))
    one = codes.document_code(codes.hits(_documents(spark, sf_dir)))
    return one.join(codes.uniform_code(lines).withColumnRenamed("code", "uniform"), "id", "left")


@query("""WITH l AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '87042131' WHEN 2 THEN '84091000' WHEN 3 THEN 'bad!' END AS code, CASE WHEN o_orderkey % 3 = 0 THEN '7318.15.90' END AS fin, CASE WHEN o_orderkey % 2 = 0 THEN '39201010' END AS wiz, o_orderkey % 6 = 0 AS usr, o_orderkey % 5 = 0 AS whole FROM orders),
  c AS (SELECT id, whole, code, 0.96 + 0.08 AS s, 1 AS ord FROM l WHERE code IN ('87042131', '84091000') UNION ALL SELECT id, whole, '73181590', CASE WHEN usr THEN 0.99 ELSE 0.94 END + 0.08, 2 FROM l WHERE fin IS NOT NULL UNION ALL SELECT id, whole, wiz, 0.9, 3 FROM l WHERE wiz IS NOT NULL
    UNION ALL SELECT id, whole, '94036000', 0.7, 4 FROM l WHERE (code IS NULL OR code = 'bad!') AND id % 7 = 0),
  d AS (SELECT *, s + CASE WHEN whole AND code = '87042131' THEN 0.12 ELSE 0 END AS t FROM c WHERE NOT (whole AND code = '84091000')), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(t, 6) DESC, ord) AS k FROM d)
  SELECT id, 1 AS position, code, CAST(round(t, 4) AS DOUBLE) AS score FROM r WHERE k = 1""")
def line_code_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    lines = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.lit(1).alias("position"), none.alias("invoice_code"), F.when(k % 4 == 0, "87042131").when(k % 4 == 2, "84091000").when(k % 4 == 3, "bad!").alias("code"), F.when(k % 3 == 0, "7318.15.90").alias("final_code"),
        F.when(k % 2 == 0, "39201010").alias("wizard_code"), (k % 6 == 0).alias("by_user"), F.when(k % 5 == 0, "Truck Iveco").otherwise("steel parts").alias("description"),
    )
    found = lines.where("id % 7 = 0").select("id", F.lit(None).cast("int").alias("position"), F.lit("94036000").alias("code"), F.lit("bare").alias("source"), F.lit(0.7).alias("confidence"))
    best = codes.best_candidates(codes.line_candidates(lines, found), lines)
    return best.select("id", "position", "code", F.round("score", 4).alias("score"))


#: A line for each kind, and what it is: (text, line type, metadata, complete vehicle).
LINE_KINDS = [
    ("Transport", "SERVICE", False, False), ("ocean freight", "SERVICE", False, False), ("Mainfreight 12", "SERVICE", False, False), ("shipping cost", "SERVICE", False, False), ("courier", "SERVICE", False, False), ("Logistics", "SERVICE", False, False), ("service fee", "SERVICE", False, False),
    ("transport costs", "SERVICE", False, False), ("delivery charge", "SERVICE", False, False), ("Freight forwarding", "SERVICE", False, False), ("export costs", "SERVICE", False, False), ("Stroški izvoza", "SERVICE", False, False), ("prevoz blaga", "SERVICE", False, False), ("carriage paid", "SERVICE", False, False),
    ("2 pallets", "PACKAGING", False, False), ("PAL 80x120", "PACKAGING", False, False), ("cartons of eggs", "PACKAGING", False, False), ("ctn 5", "PACKAGING", False, False), ("gift boxes", "PACKAGING", False, False), ("wooden crate", "PACKAGING", False, False), ("packaging", "PACKAGING", False, False),
    ("packing material", "PACKAGING", False, False), ("wooden case", "PACKAGING", False, False), ("1 pallet", "PACKAGING", False, False), ("VIN WDB9630031L123456", "GOODS", True, False), ("engine power 300", "GOODS", True, False), ("ccm 1998", "GOODS", True, False), ("IBAN SI56", "GOODS", True, False), ("DDV 22", "GOODS", True, False),
    ("invoice no 7", "GOODS", True, False), ("warranty two years", "GOODS", True, False), ("12345678901234567", "GOODS", True, False), ("WDB9630031L123456", "GOODS", True, False), ("abc", "GOODS", True, False), ("", "GOODS", True, False), (None, "GOODS", True, False), ("Iveco Eurocargo", "GOODS", False, True),
    ("spare part for truck", "GOODS", False, False), ("Mercedes 25 Actros", "GOODS", False, True), ("hex bolt M8", "GOODS", False, False), ("palladium foil", "GOODS", False, False), ("boxing gloves", "GOODS", False, False), ("kompletno vozilo", "GOODS", False, True), ("Transporter model kit", "GOODS", False, False),
]


@query(f"""WITH k AS (SELECT row_number() OVER () - 1 AS i, * FROM {_values([(t, k, str(m).lower(), str(v).lower()) for t, k, m, v in LINE_KINDS], 'line, kind, metadata, vehicle')})
  SELECT o_orderkey AS id, kind, metadata = 'true' AS metadata, vehicle = 'true' AS vehicle, kind = 'GOODS' AND metadata = 'false' AS goods FROM orders JOIN k ON o_orderkey % {len(LINE_KINDS)} = i""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with each of the words that make a service, a packing, metadata or a vehicle, and lines that only look like them."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.get(F.array(*(F.lit(t) for t, *_ in LINE_KINDS)), (k % len(LINE_KINDS)).cast("int")).alias("line"))
    kind, metadata = texts_.line_type(F.col("line")), texts_.is_metadata(F.col("line"))
    return rows.select("id", kind.alias("kind"), metadata.alias("metadata"), texts_.is_complete_vehicle(F.col("line")).alias("vehicle"), ((kind == "GOODS") & ~metadata).alias("goods"))


_PHRASES = [("hydraulic cylinder seal", 9, 8, None), ("hydraulic cylinder seal kit", 9, 8, None), ("red widget", 3, 2, "below_min_frequency"), ("of the", 9, 4, "phrase_quality"), ("12 hydraulic valve", 9, 4, "phrase_quality"), ("steel goods item", 9, 4, "phrase_quality"), ("cotton summer shirts", 9, 4, "not_industrial"), ("hydraulic pump pcs", 9, 4, "numeric_fragment"), ("hydraulic hose", 9, 4, "numeric_fragment"), ("hydraulic valve 24v", 7, 5, "numeric_fragment"), ("hydraulic valve 24v block", 7, 5, None), ("bearing housing steel unit", 8, 1, "regression_only_frequency"), ("ball bearing outer ring", 8, 2, "taxonomy_covered"), ("bearing valve", 6, 3, None)]


@query(f"""WITH p AS (SELECT * FROM {_values(_PHRASES, 'phrase, f, u, reason')}), c AS (SELECT DISTINCT substr({_CODE}, 1, 2) || '000000' AS cn8 FROM part)
  SELECT cn8, phrase, reason, CASE WHEN reason IS NULL AND phrase <> 'hydraulic cylinder seal' THEN CAST(round(u * 1.5, 4) AS DOUBLE) END AS score FROM c, p""")
def tier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of every chapter with the reason against them, or the score of those that stay beside longer ones."""
    chapters = table(spark, sf_dir, "part").select(F.concat(F.substring(code_of(F.col("p_size"), F.col("p_partkey")), 1, 2), F.lit("000000")).alias("cn8")).distinct()
    rows = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(f).alias("frequency"), F.lit(u).alias("unique_descriptions")) for p, f, u, _ in _PHRASES))
    stats = chapters.select("cn8", F.inline(rows))
    verdict = mining.phrase_verdict(F.col("phrase"), F.col("frequency"), F.col("unique_descriptions") == 1, F.col("phrase").startswith("ball bearing"), ["hydraulic", "bearing", "valve", "cylinder"], ["goods", "item", "steel"])
    kept, _ = mining.tier_candidates(stats, verdict, F.lit(0.5))
    return stats.select("cn8", "phrase", verdict.alias("reason")).join(kept.select("cn8", "phrase", "score"), ["cn8", "phrase"], "left")


#: (terms, families, heading, description, score of 10 by the query's terms, by the families of clothes, within headings by family)
_TUNED = [
    ("pellet", "", "9306", "cartridges and revolvers", 10 * 1.35 * 1.2 * 0.55, 10, 10), ("pellet rifle", "", "9306", "cartridges", 10 * 1.35 * 1.2, 10, 10), ("pellets", "", "9304", "guns", 1.2, 10, 10), ("ibuprofen", "", "2941", "x", 1.5, 10, 10), ("ibuprofen", "", "3004", "x", 10, 10, 10),
    ("motor servo", "electric_motor", "8501", "dc motor", 14.5, 10, (10 + 10.5) * 1.35 * 1.4), ("motor", "electric_motor", "8708", "axle", 10, 10, 0.4), ("chair office", "furniture_office_chair", "9401", "seat", 14, 10, 16.5), ("chair", "furniture_cabinet", "9402", "x", 10, 10, 0.4), ("pen", "stationery_pen", "9608", "refill; refills for ballpoint, liquid ink", 10 * 0.06 * 1.35, 10, 0.6),
    ("refill ink", "stationery_pen_refill", "9608", "refill", 14, 10, 14), ("cartridge toner", "office_printer_consumable", "3215", "ink", 14.5, 10, 18.75), ("ups", "ups", "8504", "exceeding 500 kva", 14, 10, 1), ("x", "apparel_tshirt_mens", "6109", "x", 10, 17, 10), ("x", "apparel_tshirt_mens", "6106", "x", 10, 1.2, 10), ("x", "apparel_polo_mens", "6110", "x", 10, 17, 10),
    ("woven", "apparel_trousers_mens", "6103", "x", 10, 0.5, 10), ("x", "apparel_trousers_mens", "6204", "x", 10, 0.6, 10), ("x", "silicone_sealant", "3214", "x", 10, 10, 24.9), ("x", "furniture_fittings", "8302", "hinge", 10, 10, 27.54), ("x", "pressure_sensor", "9026", "flow meter", 10, 10, 2.8), ("x", "", "0101", "x", 10, 10, 10),
]


@query(f"""SELECT o_orderkey AS id, CAST(round(a, 4) AS DOUBLE) AS by_terms, CAST(round(b, 4) AS DOUBLE) AS by_clothes, CAST(round(c, 4) AS DOUBLE) AS by_family FROM orders JOIN {_values([(i, float(a), float(b), float(c)) for i, (*_, a, b, c) in enumerate(_TUNED)], 'i, a, b, c')} ON o_orderkey % {len(_TUNED)} = i""")
def score_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cases = F.array(*(F.struct(F.split(F.lit(t), " ").alias("terms"), F.split(F.lit(f), " ").alias("families"), F.lit(h).alias("heading"), F.lit(d).alias("says")) for t, f, h, d, *_ in _TUNED))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.get(cases, (k % len(_TUNED)).cast("int")).alias("c")).select("id", "c.*")
    tuned = lambda steps: F.round(tuning.applied(F.lit(10.0), steps, F.col("terms"), F.col("families"), F.col("heading"), F.col("says")), 4)
    return rows.select("id", tuned(tuning.QUERY_STEPS).alias("by_terms"), tuned(tuning.APPAREL_STEPS).alias("by_clothes"), tuned(tuning.FAMILY_STEPS).alias("by_family"))


@query("""WITH o AS (SELECT o_orderkey AS id, ['8701', '8703', '8704', '8716', '8501'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS h, ['tractor_unit', 'goods_vehicle', 'passenger_vehicle', 'trailer'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS f, o_orderkey % 3 AS c FROM orders)
  SELECT id, CAST(round(CASE WHEN h = '8501' THEN 10 * 0.04 ELSE (20 + CASE WHEN h = '8703' THEN 7 ELSE 0 END) * CASE c WHEN 0 THEN 1.3 WHEN 1 THEN 1.2 ELSE 1.0 END * CASE WHEN f = 'goods_vehicle' AND h IN ('8704', '8701') THEN 1.15 WHEN f = 'tractor_unit' AND h = '8701' THEN 1.2 WHEN f = 'passenger_vehicle' AND h = '8703' THEN 1.25 WHEN f = 'trailer' AND h = '8716' THEN 1.3 ELSE 1.0 END END, 4) AS DOUBLE) AS score,
    CASE WHEN h = '8501' THEN 10.0::DOUBLE ELSE 80.0::DOUBLE END + CASE WHEN c = 0 THEN 30 ELSE 0 END AS layers FROM o""")
def vehicle_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda xs: F.get(F.array(*(F.lit(x) for x in xs)), (k % len(xs)).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), pick(["8701", "8703", "8704", "8716", "8501"]).alias("h"), pick(["tractor_unit", "goods_vehicle", "passenger_vehicle", "trailer"]).alias("f"), pick(["used", "new", "other"]).alias("c"))
    score = tuning.vehicle(F.lit(10.0), F.array("f"), F.col("h"), F.array(F.lit("8703")), F.col("c"), F.concat(F.col("c"), F.lit(" lorry")))
    layers = ranking.universal_layers(F.col("h") != "8501", F.col("c") == "used", F.col("h").startswith("87"), F.lit(True))
    return rows.select("id", F.round(score, 4).alias("score"), layers.alias("layers"))


_MACHINE_HEADINGS = ["9025", "9026", "9032", "8536", "8537", "8504", "8543", "8528", "9608", "9612", "8501", "8703", "9401", "3215", "8443"]
_GOODS = ["temperature_sensor", "proximity_sensor", "pressure_sensor", "frequency_inverter", "power_supply", "ups", "electronics_monitor", "stationery_marker", "electric_motor", "furniture_office_chair", "office_printer_consumable"]
_MACHINE_SAYS = [
    "clinical thermometer", "pyrometer", "pressure gauge", "inductive proximity switch", "programmable controller", "battery clamp", "uninterruptible supply", "static converter", "marker pen", "ribbon", "diesel engine", "diesel inverter", "compression-ignition", "other",
]


@query(f"""WITH o AS (SELECT l_orderkey AS id, l_linenumber AS position, l_partkey AS part_id, l_suppkey AS supplier_id, l_quantity AS s0, [{", ".join(f"'{x}'" for x in _MACHINE_HEADINGS)}][l_partkey % {len(_MACHINE_HEADINGS)} + 1] AS h, [{", ".join(f"'{x}'" for x in _GOODS)}][l_suppkey % {len(_GOODS)} + 1] AS f,
    [{", ".join(f"'{x}'" for x in _GOODS)}][l_orderkey % {len(_GOODS)} + 1] AS g, [{", ".join(f"'{x}'" for x in _MACHINE_SAYS)}][(l_partkey + l_orderkey) % {len(_MACHINE_SAYS)} + 1] AS d, l_linenumber % 2 = 0 AS se, l_linenumber % 3 = 0 AS au, l_returnflag = 'A' AS hi, l_returnflag = 'R' AND l_partkey % 4 = 0 AS pe, l_suppkey % 7 = 0 AS ex FROM lineitem),
  p AS (SELECT *, se AND 'temperature_sensor' IN (f, g) AS te, se AND 'proximity_sensor' IN (f, g) AS pr, se AND 'pressure_sensor' IN (f, g) AS ps, d LIKE '%inductive%' AS ne, d LIKE '%meter' AS th FROM o),
  q AS (SELECT *, s0 + CASE WHEN se AND h LIKE '90%' THEN 9.0::DOUBLE ELSE 0 END AS s1, s1 + CASE WHEN se AND hi THEN 6.5::DOUBLE ELSE 0 END AS s2, s2 * CASE WHEN th AND te THEN 1.25::DOUBLE WHEN d LIKE 'clinical%' AND pr THEN 0.45::DOUBLE ELSE 1 END AS s3,
    s3 * CASE WHEN ps AND d = 'pressure gauge' THEN 1.2::DOUBLE ELSE 1 END AS s4, CASE WHEN pr AND h = '8536' THEN s4 + 6.5::DOUBLE * 1.85::DOUBLE WHEN pr AND h = '9032' AND ne THEN s4 + 6.5::DOUBLE WHEN pr AND h = '9032' THEN s4 * 0.22::DOUBLE WHEN pr AND h IN ('9025', '9026') AND NOT ne THEN s4 * 0.1::DOUBLE ELSE s4 END AS s5,
    s5 * CASE WHEN pr AND ne THEN 1.25::DOUBLE ELSE 1 END AS s6, CASE WHEN au AND h = '8537' THEN (s6 + 7) * CASE WHEN d LIKE 'programmable%' THEN 1.2::DOUBLE ELSE 1 END ELSE s6 END AS s7, s7 + CASE WHEN h = '8504' AND 'frequency_inverter' IN (f, g) THEN 7 * 1.2::DOUBLE ELSE 0 END AS s8,
    s8 + CASE WHEN h = '8504' AND 'power_supply' IN (f, g) THEN 7 ELSE 0 END AS s9, CASE WHEN 'ups' NOT IN (f, g) THEN s9 WHEN h = '8543' THEN s9 * 0.05::DOUBLE WHEN h = '8536' THEN s9 * 0.04::DOUBLE * CASE WHEN d LIKE 'battery%' THEN 0.15::DOUBLE ELSE 1 END
      WHEN h = '8504' THEN (s9 + 7 * 1.55::DOUBLE) * CASE WHEN d IN ('uninterruptible supply', 'static converter') THEN 1.35::DOUBLE ELSE 1 END ELSE s9 END AS s10, s10 + CASE WHEN h = '8528' AND 'electronics_monitor' IN (f, g) THEN 6.5::DOUBLE * 1.2::DOUBLE ELSE 0 END AS s11,
    CASE WHEN 'stationery_marker' NOT IN (f, g) THEN s11 ELSE (s11 + CASE WHEN h = '9608' AND d = 'marker pen' THEN 7 * 1.3::DOUBLE ELSE 0 END) * CASE WHEN h = '9612' OR d = 'ribbon' THEN 0.06::DOUBLE ELSE 1 END END AS s12,
    s12 * CASE WHEN 'frequency_inverter' IN (f, g) AND d IN ('diesel engine', 'compression-ignition') THEN 0.08::DOUBLE ELSE 1 END AS s13, CASE WHEN 'electric_motor' NOT IN (f, g) THEN s13 WHEN h = '8501' THEN s13 + 7 * 1.3::DOUBLE WHEN h LIKE '87%' THEN s13 * 0.05::DOUBLE ELSE s13 END AS s14,
    s14 + CASE WHEN h = '9401' AND 'furniture_office_chair' IN (f, g) THEN 6.5::DOUBLE ELSE 0 END AS s15, CASE WHEN 'office_printer_consumable' NOT IN (f, g) THEN s15 WHEN h = '3215' THEN s15 + 7 WHEN h = '8443' THEN s15 * 0.05::DOUBLE ELSE s15 END AS s16 FROM p)
  SELECT id, position, part_id, supplier_id, floor(s16 * CASE WHEN pe THEN 0.03::DOUBLE ELSE 1 END * CASE WHEN ex THEN 0.05::DOUBLE ELSE 1 END * 10000 + 0.5) / 10000 AS score FROM q""")
def industrial_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, k: F.get(F.array(*(F.lit(x) for x in xs)), (k % len(xs)).cast("int"))
    order, part, supplier, at, flag = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(order.alias("id"), at.alias("position"), part.alias("part_id"), supplier.alias("supplier_id"), "l_quantity", "l_returnflag", pick(_MACHINE_HEADINGS, part).alias("h"), F.array(pick(_GOODS, supplier), pick(_GOODS, order)).alias("f"), pick(_MACHINE_SAYS, part + order).alias("d"))
    model = F.when(F.col("supplier_id") % 7 == 0, F.array(F.lit("x12"))).otherwise(F.array(F.lit("x12"), F.lit("relay")))
    score = tuning.industrial(
        F.col("l_quantity"), F.col("position") % 2 == 0, F.col("position") % 3 == 0, F.col("f"), F.col("h"), F.when(flag == "A", F.array("h")), F.when((flag == "R") & (F.col("part_id") % 4 == 0), F.array("h")), model, F.array(F.lit("x12")), F.col("d")
    )
    return rows.select("id", "position", "part_id", "supplier_id", (F.floor(score * 10000 + 0.5) / 10000).alias("score"))
