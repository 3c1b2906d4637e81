"""Ingest, profiles, comparison with expected results and accuracy over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.operators import golden, ingest, scoring
from customsloom.plans.bindings import INVOICES, LINES, invoices, lines, table
from customsloom.plans.registry import query

_RAW = """raw AS (SELECT l_orderkey * 10 + l_linenumber AS idx0, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_orderkey AS o, l_partkey AS p, l_linenumber AS n,
    CASE l_partkey % 9 WHEN 0 THEN 'S' WHEN 1 THEN 'DE' WHEN 2 THEN 'fr' ELSE 'SI' END AS export_country, CASE l_suppkey % 6 WHEN 0 THEN 'XS' ELSE 'AT' END AS import_country,
    CASE WHEN l_orderkey % 50 = 0 THEN 'Tarifa' WHEN l_partkey % 13 = 0 THEN '12.34' ELSE lpad(CAST(l_partkey AS VARCHAR), 10, '7') END AS tariff,
    CASE WHEN l_partkey % 17 = 0 THEN 'ab' ELSE CAST(l_linenumber AS VARCHAR) || ' KOS part ' || CAST(l_partkey % 40 AS VARCHAR) END AS description, CASE WHEN l_linenumber = 3 THEN '' ELSE replace(CAST(l_linenumber AS VARCHAR) || '.5', '.', ',') END AS net_mass FROM lineitem)"""
_CLEAN = f"""{_RAW}, s0 AS (SELECT *, regexp_replace(tariff, '[^0-9]', '', 'g') AS dg, trim(regexp_replace(regexp_replace(description, '^[0-9]+[ ,.]*', ''), ' +', ' ', 'g'), ' ,;:-') AS dn FROM raw),
  s1 AS (SELECT *, CASE WHEN length(dg) >= 8 THEN substr(dg, 1, 8) END AS cn8, CASE WHEN length(export_country) = 2 THEN upper(export_country) END AS ec, n + 0.5 AS m0 FROM s0),
  s2 AS (SELECT *, CASE WHEN tariff = 'Tarifa' THEN 'header_repeat' WHEN cn8 IS NULL THEN 'invalid_tariff' WHEN length(description) < 3 THEN 'empty_description' WHEN ec IS NULL THEN 'invalid_countries' END AS r0, CASE WHEN n = 3 THEN NULL ELSE m0 END AS mass FROM s1),
  s3 AS (SELECT *, row_number() OVER (PARTITION BY coalesce(r0, ''), ec, import_country, cn8, dn, mass ORDER BY idx) AS k FROM s2), clean AS (SELECT *, coalesce(r0, CASE WHEN k > 1 THEN 'duplicate' END) AS reject_reason FROM s3)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declaration records with every kind of fault; ``idx`` orders equal records (any order of wholly equal ones gives the same counts)."""
    o, p, n, s = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("idx"),
        F.when(p % 9 == 0, "S").when(p % 9 == 1, "DE").when(p % 9 == 2, "fr").otherwise("SI").alias("export_country"), F.when(s % 6 == 0, "XS").otherwise("AT").alias("import_country"),
        F.when(o % 50 == 0, "Tarifa").when(p % 13 == 0, "12.34").otherwise(F.lpad(p.cast("string"), 10, "7")).alias("tariff"),
        F.when(p % 17 == 0, "ab").otherwise(F.concat(n.cast("string"), F.lit(" KOS part "), (p % 40).cast("string"))).alias("description"), F.when(n == 3, "").otherwise(F.concat(n.cast("string"), F.lit(",5"))).alias("net_mass"),
    )


@query(f"WITH {_CLEAN} SELECT coalesce(reject_reason, 'kept') AS reject_reason, count(*) AS n FROM clean GROUP BY 1")
def ingest_reject_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.classify(_raw(spark, sf_dir)).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CLEAN} SELECT count(*) AS rows_read, count(*) FILTER (reject_reason IS NULL) AS rows_inserted, count(*) FILTER (reject_reason = 'header_repeat') AS skipped_header_repeat, count(*) FILTER (reject_reason = 'invalid_tariff') AS skipped_invalid_tariff,
  count(*) FILTER (reject_reason = 'empty_description') AS skipped_empty_description, count(*) FILTER (reject_reason = 'invalid_countries') AS skipped_invalid_countries, count(*) FILTER (reject_reason = 'duplicate') AS skipped_duplicate FROM clean""")
def ingest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.statistics(ingest.classify(_raw(spark, sf_dir)))


@query(f"""WITH {_CLEAN} SELECT dn AS description_normalized, cn8, substr(cn8, 1, 4) AS heading_code, import_country, '[' || concat_ws(',', '"has_quantity_prefix"', CASE WHEN import_country = 'XS' THEN '"statistical_destination"' END, CASE WHEN mass IS NULL THEN '"missing_mass"' END) || ']' AS quality_flags, count(*) AS n
  FROM clean WHERE reject_reason IS NULL GROUP BY ALL""")
def ingest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ingest.classify(_raw(spark, sf_dir)).withColumn("idx", F.xxhash64("idx"))
    return ingest.records(kept, "export").groupBy("description_normalized", "cn8", "heading_code", "import_country", "quality_flags").agg(F.count("*").alias("n"))


@query(f"""WITH {_RAW}, s AS (SELECT *, regexp_replace(tariff, '[^0-9]', '', 'g') AS dg FROM raw), t AS (SELECT *, CASE WHEN length(dg) >= 8 THEN substr(dg, 1, 8) END AS cn8 FROM s),
  g AS (SELECT count(*) AS a, coalesce(sum(n - 1), 0) AS b FROM (SELECT count(*) AS n FROM t GROUP BY export_country, import_country, cn8, description, net_mass HAVING count(*) > 1))
  SELECT count(*) AS records, count(DISTINCT cn8) AS unique_cn8, count(*) FILTER (trim(description) = '') AS empty_descriptions, count(*) FILTER (trim(tariff) = '') AS invalid_tariffs, count(*) FILTER (cn8 IS NULL) AS invalid_cn8, 0::BIGINT AS normalization_failures,
    any_value(a) AS duplicate_groups, CAST(any_value(b) AS BIGINT) AS duplicate_records FROM t, g""")
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions import tariff

    rows = _raw(spark, sf_dir).withColumn("cn8", tariff.cn8(F.col("tariff")))
    return ingest.audit(rows, ["export_country", "import_country", "cn8", "description", "net_mass"])


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 100")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.top(table(spark, sf_dir, "part"), 100, "p_brand", "p_type")


@query(f"WITH {_RAW} SELECT length(tariff) AS length, count(*) AS n FROM raw GROUP BY 1")
def normalization_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.length_histogram(_raw(spark, sf_dir), "tariff")


@query("""WITH b AS (SELECT CASE WHEN value / 100 >= 0.85 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' WHEN value / 100 > 0 THEN 'low' ELSE 'none' END AS band FROM events)
  SELECT band, count(*) AS n, floor(count(*) * 100 / CAST((SELECT count(*) FROM events) AS DOUBLE) * 100 + 0.5) / 100 AS percent FROM b GROUP BY 1""")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.confidence_buckets(table(spark, sf_dir, "events").withColumn("c", F.col("value") / 100), "c")


_PAIR = """e AS (SELECT o_orderkey AS id, o_totalprice AS value, o_orderstatus || ' Corp ' || CAST(o_custkey AS VARCHAR) AS exporter, CAST(o_orderkey % 100 AS INTEGER) AS completeness, o_orderpriority AS readiness FROM orders),
  a AS (SELECT id, CASE WHEN id % 7 = 0 THEN value + 0.03 WHEN id % 7 = 1 THEN value + 0.01 ELSE value END AS value, CASE WHEN id % 5 = 0 THEN exporter || ' Ltd' WHEN id % 11 = 0 THEN 'other' ELSE upper(exporter) END AS exporter, CASE WHEN id % 3 = 0 THEN completeness + 1 WHEN id % 13 = 0 THEN completeness + 2 ELSE completeness END AS completeness,
    CASE WHEN id % 17 = 0 THEN 'X' ELSE lower(readiness) || ' ' END AS readiness FROM e WHERE id % 19 <> 0)"""
_DIFF = f"""{_PAIR}, j AS (SELECT e.id, e.value AS ev, a.value AS av, e.exporter AS ee, a.exporter AS ae, e.completeness AS ec, a.completeness AS ac, e.readiness AS er, a.readiness AS ar, a.id AS aid FROM e LEFT JOIN a USING (id)),
  diff AS (SELECT id, 'value' AS field FROM j WHERE aid IS NOT NULL AND abs(ev - av) > 0.02 UNION ALL SELECT id, 'exporter' FROM j WHERE aid IS NOT NULL AND NOT contains(lower(ae), lower(ee)) UNION ALL SELECT id, 'completeness' FROM j WHERE abs(ec - ac) > 1
    UNION ALL SELECT id, 'readiness' FROM j WHERE aid IS NOT NULL AND lower(trim(er)) <> lower(trim(ar)) UNION ALL SELECT id, 'MISSING_RESULT' FROM j WHERE aid IS NULL)"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_totalprice").alias("value"), F.concat(F.col("o_orderstatus"), F.lit(" Corp "), F.col("o_custkey").cast("string")).alias("exporter"), (k % 100).cast("int").alias("completeness"), F.col("o_orderpriority").alias("readiness"))
    i = F.col("id")
    a = e.where("id % 19 <> 0").select(
        "id", F.when(i % 7 == 0, F.col("value") + 0.03).when(i % 7 == 1, F.col("value") + 0.01).otherwise(F.col("value")).alias("value"), F.when(i % 5 == 0, F.concat("exporter", F.lit(" Ltd"))).when(i % 11 == 0, "other").otherwise(F.upper("exporter")).alias("exporter"),
        F.when(i % 3 == 0, F.col("completeness") + 1).when(i % 13 == 0, F.col("completeness") + 2).otherwise(F.col("completeness")).alias("completeness"), F.when(i % 17 == 0, "X").otherwise(F.concat(F.lower("readiness"), F.lit(" "))).alias("readiness"),
    )
    return e, a, {"value": "number", "exporter": "contains", "completeness": "number:1", "readiness": "normalized"}


@query(f"WITH {_DIFF} SELECT id, field FROM diff")
def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a, fields = _pair(spark, sf_dir)
    return golden.compare(e, a, "id", fields)


@query(f"""WITH {_DIFF}, allowed AS (SELECT id, 'exporter' AS field FROM e WHERE id % 2 = 0), d AS (SELECT * FROM diff WHERE NOT EXISTS (SELECT 1 FROM allowed x WHERE x.id = diff.id AND x.field = diff.field)),
  c AS (SELECT id, CAST(id % 101 AS DOUBLE) AS a, id % 3 <> 0 AS r, id IN (SELECT id FROM d) AS f FROM e), s AS (SELECT count(*) AS total, count(*) FILTER (NOT f) AS passed, avg(a) AS a, avg(CAST(r AS DOUBLE)) AS r FROM c)
  SELECT total, passed, floor(1.0::DOUBLE * passed / total * 100 * 100 + 0.5) / 100 AS pass_rate, floor(a * 100 + 0.5) / 100 AS avg_accuracy, floor((1.0::DOUBLE * passed / total * 0.4 + a / 100 * 0.35 + r * 0.25) * 100 * 10 + 0.5) / 10 AS production_readiness FROM s""")
def golden_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a, fields = _pair(spark, sf_dir)
    allowed = e.where("id % 2 = 0").select("id", F.lit("exporter").alias("field"))
    left = golden.without_allowed(golden.compare(e, a, "id", fields), allowed, "id")
    return golden.summary(e.select("id", (F.col("id") % 101).cast("double").alias("accuracy"), (F.col("id") % 3 != 0).alias("readiness_ok")), left, "id")


@query(f"WITH {_DIFF}, r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY id) AS k FROM diff) SELECT field, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (k <= 20) AS cases FROM r GROUP BY 1")
def golden_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a, fields = _pair(spark, sf_dir)
    return golden.defects(golden.compare(e, a, "id", fields), "id")


@query("""WITH l AS (SELECT lang, quality = 1 AS c, toxic = 0 AND n_chars > 1000 AS b FROM labels JOIN documents USING (doc_id))
  SELECT coalesce(lang, 'TOTAL') AS category, count(*) AS n, floor(avg(CAST(c AS DOUBLE)) * 10000 + 0.5) / 10000 AS accuracy, floor(avg(CAST(b AS DOUBLE)) * 10000 + 0.5) / 10000 AS baseline_accuracy, count(*) FILTER (c AND NOT b) AS improved, count(*) FILTER (NOT c AND b) AS regressed
  FROM l GROUP BY ROLLUP (lang)""")
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = golden.accuracy(rows, "lang", F.col("quality") == 1, (F.col("toxic") == 0) & (F.col("n_chars") > 1000))
    return out.select(F.coalesce("lang", F.lit("TOTAL")).alias("category"), "n", "accuracy", "baseline_accuracy", "improved", "regressed")


_MESSAGES = [
    "No preferential origin declaration found", "Missing country of origin on lines", "Destination is within the EU customs territory", "Missing gross weight", "Net weight not found", "Package count is missing", "HS codes not detected", "Missing VAT article",
    "VAT legal article absent", "Gross shipment weight is missing", "net shipment weight is missing", "Note: CHECK_TOTALS by hand", "Something  else", "Invoice value missing",
]
_FIELDS = ["NO_HS_CODES", " eu_destination ", "MISSING_NET_WEIGHT", "", "NO_COUNTRY_OF_ORIGIN"]
_ISSUES = f"""{LINES}, {INVOICES}, f AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, l_partkey AS part_id, l_suppkey AS supplier_id, [{", ".join(f"'{m}'" for m in _MESSAGES)}][l_partkey % {len(_MESSAGES)} + 1] AS message,
    CASE WHEN l_suppkey % 3 = 0 THEN [{", ".join(f"'{m}'" for m in _FIELDS)}][l_partkey % {len(_FIELDS)} + 1] END AS field FROM lineitem),
  w AS (SELECT invoice_id, bool_or(preference = 'YES') AS yes, sum(net_weight) AS net, count(*) FILTER (brand < 'Brand#2') AS cartons, count(*) FILTER (brand > 'Brand#4') AS pallets, count(*) FILTER (part_id % 3 = 0) AS codes, count(DISTINCT CASE WHEN part_id % 4 = 0 THEN country END) AS countries, bool_or(part_id % 5 > 0) AS data FROM lines GROUP BY 1),
  s AS (SELECT invoice_id, coalesce(yes, false) AS yes, n_name IN ('FRANCE', 'GERMANY', 'ROMANIA') AS eu, net, CASE WHEN i.status <> 'O' THEN net * 1.1 END AS gross, cartons, pallets, priority LIKE '1%' AS ct, coalesce(codes, 0) AS codes, coalesce(countries, 0) AS countries, coalesce(data, true) AS data, segment = 'BUILDING' AS vat
    FROM invoices i JOIN nation ON destination = n_nationkey LEFT JOIN w USING (invoice_id)),
  c AS (SELECT *, lower(message) AS m, CASE WHEN trim(coalesce(field, '')) <> '' THEN upper(trim(field)) WHEN regexp_matches(message, '(?i)vat (legal )?article') THEN 'MISSING_VAT_ARTICLE' WHEN message ILIKE 'net %' THEN 'MISSING_NET_WEIGHT' WHEN message LIKE 'Missing country%' THEN 'MISSING_COUNTRY_OF_ORIGIN'
      WHEN message = 'Invoice value missing' THEN 'MISSING_INVOICE_VALUE' WHEN message LIKE '%CHECK_TOTALS%' THEN 'CHECK_TOTALS' WHEN message LIKE '%HS %' THEN lower(message) WHEN message LIKE '%VAT %' THEN 'VAT' ELSE lower(regexp_replace(message, ' +', ' ', 'g')) END AS code FROM f)"""


@query(f"""WITH {_ISSUES} SELECT invoice_id, position, part_id, supplier_id, code, CASE
    WHEN yes AND (code IN ('NO_COUNTRY_OF_ORIGIN', 'MISSING_COUNTRY_OF_ORIGIN') OR m LIKE '%no preferential origin%' OR m LIKE '%missing country of origin%') THEN 'origin_declared' WHEN NOT eu AND (code = 'EU_DESTINATION' OR m LIKE '%within the eu customs%') THEN 'outside_union'
    WHEN NOT data AND (code IN ('MISSING_NET_WEIGHT', 'MISSING_GROSS_WEIGHT') OR m LIKE '%gross%missing%' OR m = 'missing gross weight' OR m LIKE '%package%' OR m = 'net weight not found') THEN 'no_shipment_data' WHEN gross > 0 AND m LIKE '%gross%' THEN 'gross_known'
    WHEN net IS NOT NULL AND (code = 'MISSING_NET_WEIGHT' OR m LIKE 'net shipment%') THEN 'net_known' WHEN (coalesce(cartons, 0) > 0 OR coalesce(pallets, 0) > 0) AND m LIKE '%package%' THEN 'packages_known' WHEN codes > 0 AND (code = 'NO_HS_CODES' OR m LIKE 'hs codes%') THEN 'codes_known'
    WHEN countries > 0 AND (code IN ('NO_COUNTRY_OF_ORIGIN', 'MISSING_COUNTRY_OF_ORIGIN') OR m LIKE '%country of origin%') THEN 'countries_known' WHEN vat AND code = 'MISSING_VAT_ARTICLE' THEN 'vat_article' END AS resolved_by FROM c LEFT JOIN s USING (invoice_id)""")
def issue_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue a line, settled or not by what the invoice's other lines, destination and weights tell."""
    part, pick = F.col("l_partkey"), lambda xs: F.get(F.array(*(F.lit(x) for x in xs)), (F.col("l_partkey") % len(xs)).cast("int"))
    issues = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position"), part.alias("part_id"), F.col("l_suppkey").alias("supplier_id"), pick(_MESSAGES).alias("message"), F.when(F.col("l_suppkey") % 3 == 0, pick(_FIELDS)).alias("field"))
    found = lines(spark, sf_dir).groupBy("invoice_id").agg(
        F.max(F.col("preference") == "YES").alias("yes"), F.sum("net_weight").alias("net"), F.count_if(F.col("brand") < "Brand#2").alias("cartons"), F.count_if(F.col("brand") > "Brand#4").alias("pallets"),
        F.count_if(F.col("part_id") % 3 == 0).alias("codes"), F.count_distinct(F.when(F.col("part_id") % 4 == 0, F.col("country"))).alias("countries"), F.max(F.col("part_id") % 5 > 0).alias("data"),
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("destination"), F.when(F.col("n_name") == "FRANCE", "FR").when(F.col("n_name") == "GERMANY", "DE").when(F.col("n_name") == "ROMANIA", "RO").otherwise("XX").alias("to"))
    rows = invoices(spark, sf_dir).join(nation, "destination").join(found, "invoice_id", "left")
    state = scoring.resolutions(F.col("yes"), F.col("to"), F.when(F.col("status") != "O", F.col("net") * 1.1), F.col("net"), F.col("cartons"), F.col("pallets"), F.when(F.col("priority").startswith("1"), "CT"), F.col("codes"), F.col("countries"), F.col("data"), F.col("segment") == "BUILDING")
    return scoring.with_resolution(issues, rows.select("invoice_id", state.alias("resolved"))).drop("message", "field")
