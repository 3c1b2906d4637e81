"""Reconciliation, positions, duplicates, codes, dates, origin and readiness over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.functions import dates, numbers, tariff, text
from customsloom.operators import origin, reconcile, scoring
from customsloom.plans.bindings import INVOICES, LINES, invoices, lines, money, table
from customsloom.plans.registry import query

_STATUS = "CASE WHEN r IS NULL OR (r > 0.01 AND r <= 0.05) THEN 'WARNING' WHEN r <= 0.01 THEN 'PASS' ELSE 'FAIL' END"


@query(f"""WITH {LINES}, {INVOICES}, s AS (SELECT invoice_id, {money('sum(line_total)')} AS c FROM lines GROUP BY 1),
  t AS (SELECT invoice_id, total_value AS t, c, CASE WHEN c > 0 AND total_value > 0 THEN abs(c - total_value) / greatest(abs(total_value), 0.01) END AS r FROM invoices LEFT JOIN s USING (invoice_id))
  SELECT invoice_id, t AS invoice_total, c AS calculated_total, CASE WHEN r IS NOT NULL THEN {money('abs(c - t)')} END AS difference, {_STATUS} AS validation_status FROM t""")
def invoice_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.totals(reconcile.line_sum(lines(spark, sf_dir)), invoices(spark, sf_dir))


@query(f"""WITH {LINES}, {INVOICES}, s AS (SELECT invoice_id, {money('sum(line_total)')} AS l FROM lines GROUP BY 1), t AS (SELECT invoice_id, total_value AS h, l FROM invoices LEFT JOIN s USING (invoice_id))
  SELECT invoice_id, CASE WHEN h > 0 AND l > 0 THEN {money('CASE WHEN greatest(h, l) > least(h, l) * 1.5 THEN least(h, l) ELSE h END')} WHEN h > 0 THEN h WHEN l > 0 THEN l ELSE 0.0 END AS canonical_total,
    CASE WHEN h > 0 AND l > 0 THEN floor(abs(h - l) / greatest(h, l) * 1000000 + 0.5) / 1000000 ELSE 0.0 END AS max_deviation FROM t""")
def canonical_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = invoices(spark, sf_dir).join(reconcile.line_sum(lines(spark, sf_dir)), "invoice_id", "left")
    deviation = numbers.round_up(reconcile.largest_deviation(F.array("total_value", "calculated_total")), 6)
    return both.select("invoice_id", reconcile.canonical_total(F.col("total_value"), F.col("calculated_total")).alias("canonical_total"), deviation.alias("max_deviation"))


_EXPECTED = "SELECT invoice_id, CAST(unnest(generate_series({lo}, max(position))) AS INTEGER) AS position FROM lines GROUP BY invoice_id"


@query(f"WITH {LINES} SELECT e.* FROM ({_EXPECTED.format(lo='min(position)')}) e WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.invoice_id = e.invoice_id AND l.position = e.position)")
def position_gaps_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_positions(lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT e.* FROM ({_EXPECTED.format(lo='1')}) e WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.invoice_id = e.invoice_id AND l.position = e.position)")
def position_gaps_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.missing_positions(lines(spark, sf_dir), first="one")


@query(f"WITH {LINES}, t AS (SELECT invoice_id, position, lag(position) OVER (PARTITION BY invoice_id ORDER BY position) AS previous FROM lines) SELECT * FROM t WHERE position - previous > 1")
def position_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.sequence_breaks(lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT invoice_id, position, count(*) AS occurrences FROM lines GROUP BY 1, 2 HAVING count(*) > 1")
def position_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.duplicate_positions(lines(spark, sf_dir))


@query("""WITH t AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, p_name AS style, l_returnflag AS colour, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, position, colour ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY invoice_id, position, colour) AS copies FROM t)
  SELECT invoice_id, position, colour, copies, l_extendedprice AS line_total FROM r WHERE k = 1""")
def exact_identity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position"), F.col("l_returnflag").alias("colour"), F.col("l_extendedprice").alias("line_total"))
    return reconcile.keep_first(rows, ["invoice_id", "position", "colour"], ["line_total"])


@query("""WITH l AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2), b AS (SELECT invoice_id, count(*) AS n FROM l GROUP BY 1)
  SELECT l.invoice_id, row_number() OVER (PARTITION BY l.invoice_id ORDER BY position) AS position, part FROM l JOIN b USING (invoice_id)""")
def block_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices whose lines were read two or three times over; the blocks collapse to one."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("p")).agg(F.min("l_partkey").alias("part"))
    sizes = own.groupBy("invoice_id").agg(F.count("*").alias("block"))
    read = own.select("invoice_id", "p", "part", F.explode(F.sequence(F.lit(1), F.lit(2) + (F.col("invoice_id") % 2).cast("int"))).alias("time"))
    repeated = read.select("invoice_id", "part", (F.col("time") * 1000 + F.col("p")).alias("ord"), F.concat_ws("|", "p", "part").alias("identity"))
    return reconcile.collapse_blocks(repeated, sizes).select("invoice_id", F.col("position").cast("bigint").alias("position"), "part")


@query("""WITH s AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, min(l_partkey % 10) AS style FROM lineitem GROUP BY 1, 2), e0 AS (SELECT invoice_id, position, style FROM s WHERE (invoice_id + position) % 4 <> 0),
  e AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY position) AS ord FROM e0), st AS (SELECT invoice_id, style, min(ord) AS so FROM e GROUP BY 1, 2), po AS (SELECT invoice_id, position, min(ord) AS po FROM e GROUP BY 1, 2)
  SELECT s.invoice_id, s.position, s.style, coalesce(e.ord, so, po, 0) AS matched_ord, CASE WHEN e.ord IS NOT NULL THEN 'STYLE_AT_INDEX' WHEN so IS NOT NULL THEN 'STYLE' WHEN po IS NOT NULL THEN 'POSITION' ELSE 'NONE' END AS match_tier
  FROM s LEFT JOIN e ON e.invoice_id = s.invoice_id AND e.style = s.style AND e.ord = s.position LEFT JOIN st ON st.invoice_id = s.invoice_id AND st.style = s.style LEFT JOIN po ON po.invoice_id = s.invoice_id AND po.position = s.position""")
def source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position")).agg(F.min(F.col("l_partkey") % 10).alias("style"))
    seen = reconcile.renumber(own.where((F.col("invoice_id") + F.col("position")) % 4 != 0), "invoice_id", ["position"], "ord")
    return reconcile.match_source(own, seen).fillna(0, ["matched_ord"])


@query("""WITH a AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT * FROM a WHERE (invoice_id + position) % 3 <> 0),
  n AS (SELECT invoice_id, CAST(unnest(generate_series(1, max(position))) AS INTEGER) AS position FROM a GROUP BY 1)
  SELECT n.invoice_id, n.position, a.v AS source_value, a.v IS NOT NULL AS in_source, b.v AS final_value, b.v IS NOT NULL AS in_final FROM n LEFT JOIN a USING (invoice_id, position) LEFT JOIN b USING (invoice_id, position)""")
def traceability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position"), F.col("l_quantity").alias("value"))
    return reconcile.trace_stages(2, source=own, final=own.where((F.col("invoice_id") + F.col("position")) % 3 != 0))


@query("""WITH p AS (SELECT p_brand AS brand, lower(p_name) || ' ' || CAST(p_size AS VARCHAR) AS t, min(p_partkey) AS id FROM part GROUP BY 1, 2),
  g AS (SELECT brand, t, id, list_distinct(list_transform(generate_series(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 2))) AS b FROM p)
  SELECT x.brand, x.id AS id_a, y.id AS id_b, CASE WHEN contains(x.t, y.t) OR contains(y.t, x.t) THEN 0.98::DOUBLE ELSE 2.0 * len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b)) END AS similarity
  FROM g x JOIN g y ON x.brand = y.brand AND x.id < y.id
  WHERE CASE WHEN contains(x.t, y.t) OR contains(y.t, x.t) THEN 0.98::DOUBLE ELSE 2.0 * len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b)) END >= 0.9""")
def dice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("text"))
    return reconcile.dice_pairs(rows, ["brand"], "id", "text", 0.9)


_RAW = "CASE p_partkey % 5 WHEN 0 THEN substr(c, 1, 4) || '.' || substr(c, 5, 2) || ' ' || substr(c, 7, 2) WHEN 1 THEN replace(c, '0', 'O') WHEN 2 THEN c WHEN 3 THEN 'HS-' || c ELSE CASE WHEN p_partkey % 2 = 0 THEN '' END END"


@query(f"""WITH p AS (SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 6, '0') AS c FROM part), r AS (SELECT p_partkey, {_RAW} AS raw FROM p),
  s AS (SELECT *, regexp_replace(trim(coalesce(raw, '')), '[\\s.\\-–—]+', '', 'g') AS t FROM r), u AS (SELECT *, translate(t, 'OoIilBbSs', '001118855') AS m FROM s),
  v AS (SELECT *, regexp_matches(t, '^[0-9]{{6,12}}$') AS good, regexp_matches(m, '^[0-9]{{6,12}}$') AS fixable FROM u),
  w AS (SELECT p_partkey, raw, CASE WHEN good THEN t WHEN fixable THEN m END AS code, NOT good AND NOT fixable AND regexp_matches(t, '[0-9A-Za-z]') AS invalid, NOT good AND fixable AS repaired FROM v)
  SELECT p_partkey AS part_id, code, invalid, repaired, CASE WHEN invalid THEN 'INVALID_FORMAT' WHEN code IS NULL THEN 'MISSING' WHEN substr(code, 1, 2) > '40' THEN 'UNKNOWN_HS' WHEN repaired THEN 'REPAIRED' ELSE 'VALID' END AS hs_status FROM w""")
def hs_normalise_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.plans.bindings import code_of

    c, k = code_of(F.col("p_size"), F.col("p_partkey")), F.col("p_partkey")
    raw = F.when(k % 5 == 0, F.concat(F.substring(c, 1, 4), F.lit("."), F.substring(c, 5, 2), F.lit(" "), F.substring(c, 7, 2))).when(k % 5 == 1, F.regexp_replace(c, "0", "O")).when(k % 5 == 2, c).when(k % 5 == 3, F.concat(F.lit("HS-"), c)).when(k % 2 == 0, "")
    rows = table(spark, sf_dir, "part").select(k.alias("part_id"), raw.alias("raw"))
    code, invalid, repaired = tariff.normalise(F.col("raw"))
    return rows.select("part_id", code.alias("code"), invalid.alias("invalid"), repaired.alias("repaired"), tariff.status(F.col("raw"), F.substring(code, 1, 2) <= "40").alias("hs_status"))


@query("""WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 6, '0') AS a FROM part),
  q AS (SELECT k, CASE WHEN k % 7 <> 0 THEN a END AS a, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 4 = 0 THEN a ELSE substr(a, 1, CAST(k % 8 AS INTEGER)) || lpad(CAST(k % 9 AS VARCHAR), 8 - CAST(k % 8 AS INTEGER), '9') END AS b, k % 100 AS c FROM p),
  r AS (SELECT *, coalesce(list_max(list_transform(list_filter(generate_series(1, 8), lambda i: substr(a, 1, i) = substr(b, 1, i)), lambda i: i)), 0) AS m FROM q),
  s AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(floor(m * 100.0 / greatest(length(a), length(b), 1) + 0.5) AS INTEGER) END AS similarity FROM r)
  SELECT k AS part_id, coalesce(similarity, -1) AS similarity, CASE WHEN a IS NULL AND b IS NULL THEN 'MISSING' WHEN a IS NULL THEN 'GENERATED'
    WHEN b IS NULL OR a = b OR ((substr(a, 1, 2) = substr(b, 1, 2) OR substr(a, 1, 6) = substr(b, 1, 6)) AND similarity >= 75) THEN 'VERIFIED' WHEN c >= 80 THEN 'REVIEW_REQUIRED' ELSE 'REVIEW_REQUIRED_LOW_CONFIDENCE' END AS verification FROM s""")
def hs_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.plans.bindings import code_of

    k, c = F.col("p_partkey"), code_of(F.col("p_size"), F.col("p_partkey"))
    n = (k % 8).cast("int")
    other = F.when(k % 4 == 3, None).when(k % 4 == 0, c).otherwise(F.concat(c.substr(F.lit(1), n), F.lpad((k % 9).cast("string"), 8 - n, F.lit("9"))))
    rows = table(spark, sf_dir, "part").select(k.alias("part_id"), F.when(k % 7 != 0, c).alias("a"), other.alias("b"), (k % 100).alias("c"))
    rows = rows.withColumn("similarity", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), tariff.similarity(F.col("a"), F.col("b"))))
    return rows.select("part_id", F.coalesce("similarity", F.lit(-1)).alias("similarity"), tariff.verification(F.col("a"), F.col("b"), F.col("c"), F.col("similarity"), 80, 75).alias("verification"))


@query("""WITH p AS (SELECT p_partkey AS part_id, CAST(p_retailprice AS DECIMAL(12, 2)) AS v FROM part) SELECT part_id, CAST(v AS DOUBLE) AS european, CAST(v AS DOUBLE) AS us, CAST(v AS DOUBLE) AS plain,
  CAST(floor(v) AS DOUBLE) AS quantity, CAST(replace(CAST(v AS VARCHAR), '.', '') AS DOUBLE) AS strict FROM p""")
def locale_number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in several manners and read again."""
    v = F.col("p_retailprice").cast("decimal(12,2)")
    us = F.format_number(F.col("p_retailprice"), 2)
    whole = F.concat(F.format_number(F.floor("p_retailprice"), 0), F.lit(" pcs"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), numbers.parse_locale_number(F.concat(F.lit("EUR "), F.translate(us, ",.", ".,"))).alias("european"), numbers.parse_locale_number(us).alias("us"),
        numbers.parse_locale_number(v.cast("string")).alias("plain"), numbers.parse_quantity(whole).alias("quantity"), numbers.parse_eu_strict(v.cast("string")).alias("strict"),
    )


@query("""WITH o AS (SELECT o_orderkey AS invoice_id, CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT invoice_id, CASE WHEN invoice_id % 3 = 1 AND day(d) <= 12 THEN make_date(year(d), month(d), day(d)) ELSE d END AS invoice_date,
  CASE WHEN d > DATE '2001-01-01' THEN 'INVOICE_DATE_IN_FUTURE' WHEN DATE '2001-01-01' - d > 180 THEN 'INVOICE_DATE_OLDER_THAN_180_DAYS' END AS date_issue FROM o""")
def invoice_date_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as ISO, D.M.Y and D/M/Y, read again, beside a fixed day."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    written = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "d.M.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))
    rows = table(spark, sf_dir, "orders").select(k.alias("invoice_id"), dates.parse_invoice_date(written).alias("invoice_date"))
    return rows.withColumn("date_issue", dates.date_readiness(F.col("invoice_date"), F.lit("2001-01-01").cast("date")))


_ISSUES = """issues AS (SELECT o_orderkey AS invoice_id, 'TOTAL_MISMATCH' AS code, 'error' AS kind, true AS critical FROM orders WHERE o_totalprice > 400000
  UNION ALL SELECT o_orderkey, 'MISSING_INCOTERMS', 'warning', false FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT l_orderkey, 'MISSING_COO', 'warning', true FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 40
  UNION ALL SELECT l_orderkey, 'LATE', 'info', false FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01')"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def tagged(rows: DataFrame, key: str, code: str, kind: str, critical: bool) -> DataFrame:
        return rows.select(F.col(key).alias("invoice_id"), F.lit(code).alias("code"), F.lit(kind).alias("kind"), F.lit(critical).alias("critical"))

    return (
        tagged(orders.where("o_totalprice > 400000"), "o_orderkey", "TOTAL_MISMATCH", "error", True)
        .unionByName(tagged(orders.where("o_orderpriority = '5-LOW'"), "o_orderkey", "MISSING_INCOTERMS", "warning", False))
        .unionByName(tagged(item.where("l_returnflag = 'N' AND l_quantity > 40"), "l_orderkey", "MISSING_COO", "warning", True))
        .unionByName(tagged(item.where("l_shipdate > TIMESTAMP '2001-01-01'"), "l_orderkey", "LATE", "info", False))
    )


@query(f"""WITH {_ISSUES}, c AS (SELECT invoice_id, code, max(CASE WHEN kind = 'error' THEN 18 WHEN kind = 'warning' AND critical THEN 12 WHEN kind = 'warning' THEN 3 ELSE 0 END) AS p FROM issues GROUP BY 1, 2), s AS (SELECT invoice_id, sum(p) AS p FROM c GROUP BY 1)
  SELECT o_orderkey AS invoice_id, CAST(greatest(0, least(100, 100 - coalesce(p, 0))) AS INTEGER) AS readiness_score FROM orders LEFT JOIN s ON o_orderkey = invoice_id""")
def readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.readiness(_issues(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id")))


@query(f"WITH {_ISSUES} SELECT invoice_id, count(*) FILTER (kind = 'error') AS critical, count(*) FILTER (kind = 'warning') AS warnings, count(*) FILTER (kind = 'info') AS infos FROM issues GROUP BY 1")
def issue_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_counts(_issues(spark, sf_dir), "invoice_id")


@query("""WITH i AS (SELECT o_custkey AS invoice_id, o_orderpriority AS code, CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'info' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'f' END AS field, repeat('x', CAST(o_orderkey % 9 AS INTEGER)) AS message, o_orderkey AS ord FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, code ORDER BY CASE kind WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, field IS NULL, length(message) DESC, ord) AS k FROM i) SELECT invoice_id, code, kind, field, message, ord FROM r WHERE k = 1""")
def issue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "warning").otherwise("info")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("invoice_id"), F.col("o_orderpriority").alias("code"), kind.alias("kind"), F.when(k % 2 == 0, "f").alias("field"), F.expr("repeat('x', CAST(o_orderkey % 9 AS INT))").alias("message"), k.alias("ord"))
    return scoring.dedupe_issues(rows)


@query(f"""WITH {LINES}, {INVOICES}, m AS (SELECT invoice_id, count(*) AS items, count(*) FILTER (hs_code < '30') AS h, count(*) FILTER (preference <> 'NO') AS c, count(*) FILTER (net_weight IS NOT NULL) AS q FROM lines GROUP BY 1),
  s AS (SELECT invoice_id, items, CAST(floor((1.0 * items / items * 0.25 + 1.0 * h / items * 0.25 + 1.0 * c / items * 0.15 + 1.0 * q / items * 0.1) * 100 + 0.5) AS INTEGER) AS line_score FROM m)
  SELECT invoice_id, coalesce(items, 0) AS items, coalesce(line_score, 0) AS line_score, CAST(least(CASE WHEN coalesce(items, 0) = 0 OR total_value <= 5000 THEN 70 ELSE 100 END, CASE WHEN total_value > 450000 THEN 60 ELSE 100 END,
    CASE WHEN coalesce(items, 0) = 0 THEN 80 ELSE floor(80 * 0.6 + line_score * 0.4 + 0.5) END) AS INTEGER) AS completeness FROM invoices LEFT JOIN s USING (invoice_id)""")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).groupBy("invoice_id").agg(F.count("*").alias("items"), F.count_if(F.col("hs_code") < "30").alias("h"), F.count_if(F.col("preference") != "NO").alias("c"), F.count_if(F.col("net_weight").isNotNull()).alias("q"))
    rows = invoices(spark, sf_dir).select("invoice_id", "total_value").join(own, "invoice_id", "left").fillna(0, ["items", "h", "c", "q"])
    rows = rows.withColumn("line_score", scoring.line_score(F.col("items"), description=F.col("items"), hs_code=F.col("h"), country=F.col("c"), quantity=F.col("q")))
    return rows.select("invoice_id", "items", "line_score", scoring.completeness(F.lit(80), F.col("line_score"), F.col("items"), F.col("total_value") > 5000, F.col("total_value") > 450000).alias("completeness"))


@query("""WITH d AS (SELECT o_orderkey AS invoice_id, 100.0 AS g, CASE WHEN o_orderkey % 2 = 0 THEN 100.0 ELSE 40.0 END AS pc, CAST(o_orderkey % 101 AS DOUBLE) AS pt, CASE o_orderpriority WHEN '5-LOW' THEN 0.0 ELSE 100.0 END AS inc, 70.0 AS v, CASE o_orderstatus WHEN 'F' THEN 100.0 WHEN 'O' THEN 85.0 ELSE 45.0 END AS oe, 75.0 AS dc FROM orders)
  SELECT invoice_id, CAST(floor((g * 15 + pc * 15 + pt * 10 + inc * 15 + v * 10 + oe * 20 + dc * 15) / 100 + 0.5) AS INTEGER) AS score,
    CASE least(g, pc, pt, inc, v, oe, dc) WHEN g THEN 'gross_weight' WHEN pc THEN 'package_count' WHEN pt THEN 'package_type' WHEN inc THEN 'incoterms' WHEN v THEN 'vat_article' WHEN oe THEN 'origin_evidence' ELSE 'declaration' END AS weakest FROM d""")
def customs_readiness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    scores = {
        "gross_weight": F.lit(100.0), "package_count": F.when(k % 2 == 0, 100.0).otherwise(40.0), "package_type": (k % 101).cast("double"), "incoterms": F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(100.0),
        "vat_article": F.lit(70.0), "origin_evidence": F.when(F.col("o_orderstatus") == "F", 100.0).when(F.col("o_orderstatus") == "O", 85.0).otherwise(45.0), "declaration": F.lit(75.0),
    }
    return table(spark, sf_dir, "orders").select(k.alias("invoice_id"), scoring.weighted(scores, scoring.READINESS_WEIGHTS).alias("score"), scoring.weakest(scores).alias("weakest"))


@query(f"""WITH {INVOICES} SELECT invoice_id, CASE WHEN total_value <= 5000 THEN 'CUSTOMS_BLOCKED' WHEN priority = '5-LOW' OR status = 'P' THEN 'CUSTOMS_REVIEW' ELSE 'CUSTOMS_READY' END AS customs_status,
  concat_ws(', ', CASE WHEN total_value <= 5000 THEN 'value' END, CASE WHEN priority = '5-LOW' THEN 'incoterms' END) AS missing FROM invoices""")
def customs_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = F.array(F.when(F.col("total_value") <= 5000, "Missing value"))
    review = F.array(F.when(F.col("priority") == "5-LOW", "Missing incoterms"), F.when(F.col("status") == "P", "Pending"))
    absent = scoring.missing_fields(value=F.when(F.col("total_value") > 5000, F.col("total_value")), incoterms=F.when(F.col("priority") != "5-LOW", F.col("priority")).otherwise("—"))
    return invoices(spark, sf_dir).select("invoice_id", scoring.verdict(blocked, review).alias("customs_status"), F.array_join(absent, ", ").alias("missing"))


_SCHEME = "CASE destination % 6 WHEN 0 THEN 'NO_PREFERENCE' WHEN 1 THEN 'UK' WHEN 2 THEN 'REX' WHEN 3 THEN 'PEM' WHEN 4 THEN 'PEM' ELSE 'NO_PREFERENCE' END"


@query(f"""WITH {INVOICES}, t AS (SELECT invoice_id, {_SCHEME} AS s, status = 'F' AS d, priority = '1-URGENT' AS a, invoice_id % 2 = 0 AS st, total_value <= 6000 AS small FROM invoices)
  SELECT invoice_id, s AS scheme, CASE WHEN s = 'NO_PREFERENCE' THEN 'NOT_DECLARED' WHEN s IN ('UK', 'REX') THEN CASE WHEN st THEN 'DECLARED' ELSE 'NOT_DECLARED' END WHEN d AND (a OR small) THEN 'DECLARED' WHEN d THEN 'UNVERIFIED' ELSE 'NOT_DECLARED' END AS evidence,
    CASE WHEN s = 'NO_PREFERENCE' THEN 0 WHEN s IN ('UK', 'REX') THEN CASE WHEN st THEN 1 ELSE 2 END WHEN d AND a THEN 4 WHEN d AND small THEN 1 WHEN d THEN 3 WHEN small THEN 2 ELSE 3 END AS case_id FROM t""")
def origin_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    country = F.element_at(F.array(*(F.lit(c) for c in ("DE", "GB", "CA", "CH", "RS", "US"))), (F.col("destination") % 6 + 1).cast("int"))
    rows = invoices(spark, sf_dir).withColumn("scheme", origin.scheme(country))
    evidence, case = origin.decision(F.col("scheme"), F.col("status") == "F", F.col("priority") == "1-URGENT", F.col("invoice_id") % 2 == 0, F.col("total_value"))
    return rows.select("invoice_id", "scheme", evidence.alias("evidence"), case.alias("case_id"))


#: Declarations, and what they say of lines: by position, and else.
_SAID = [
    ("EUR.1 enclosed except positions 2, 4 and 5.", {2: "NO", 4: "NO", 5: "NO"}, "UNKNOWN"),
    ("EUR.1 enclosed for all positions except 3 and 6", {3: "NO", 6: "NO"}, "YES"),
    ("All products on this invoice are of EU preferential origin.", {}, "YES"),
    ("Positions 1 and 3 are of EU preferential origin.", {1: "YES", 3: "YES"}, ""),
    ("Origin as stated except where otherwise indicated.", {}, "UNKNOWN"),
    ("The exporter of the products covered by this document (customs authorisation no SI/12/34) declares that they are of preferential origin.", {}, "YES"),
    ("The exporter of the products covered by this document declares that, except where otherwise clearly indicated, these goods have preferential origin.", {}, "YES"),
    ("Articles, which are not marked with sign (*) have no preferential origin.", {2: "YES", 4: "YES", 6: "YES"}, "NO"),
    ("LTSD on file.", {}, "UNKNOWN"), ("Manufacturer's declaration attached.", {}, "UNKNOWN"), ("Authorised exporter REX No 5", {}, ""), ("Nothing is said.", {}, ""),
    ("Preferential origin declaration applies to all goods except positions 1 and 2", {1: "NO", 2: "NO"}, "YES"),
]


@query(f"""WITH {LINES}, s(m, position, said) AS (VALUES {", ".join(f"({m}, {p}, '{by.get(p) or other or ('NOT_DECLARED' if p != 7 else 'UNKNOWN')}')" for m, (_, by, other) in enumerate(_SAID) for p in range(1, 8))})
  SELECT invoice_id, l.position, said AS preference, count(*) AS n FROM lines l JOIN s ON l.invoice_id % {len(_SAID)} = m AND l.position = s.position GROUP BY 1, 2, 3""")
def line_preference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even positions are marked with an asterisk; the country of position 7 isn't known."""
    corpus = F.get(F.array(*(F.lit(t) for t, *_ in _SAID)), (F.col("invoice_id") % len(_SAID)).cast("int"))
    rows = lines(spark, sf_dir).withColumns({"country": F.when(F.col("position") != 7, F.col("country")), "description": F.when(F.col("position") % 2 == 0, F.concat("description", F.lit(" *"))).otherwise(F.col("description"))})
    rows = rows.select("invoice_id", "position", origin.line_preference(F.col("position"), corpus, F.col("country"), F.col("description")).alias("preference"))
    return rows.groupBy("invoice_id", "position", "preference").agg(F.count("*").alias("n"))


_NO_GOODS = ["transport", "freight charge", "2 pallets", "invoice no 7", "VIN 1"]


@query(f"""WITH t AS (SELECT conv_id, turn, CASE turn % 6 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NO_GOODS))} ELSE 'steel bolt ' || turn END AS x FROM conversations)
  SELECT conv_id, count(*) AS turns, count(*) FILTER (x IN ('transport', 'freight charge')) AS services, count(*) FILTER (x = '2 pallets') AS packings, count(*) FILTER (x IN ('invoice no 7', 'VIN 1')) AS metadata,
    coalesce(string_agg(x, chr(10) ORDER BY turn, x) FILTER (x LIKE 'steel%'), '') AS goods FROM t GROUP BY 1""")
def line_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the lines of texts, and the texts without what is no goods."""
    n = F.col("turn")
    line = F.coalesce(F.get(F.array(*(F.lit(x) for x in _NO_GOODS)), (n % 6).cast("int")), F.concat(F.lit("steel bolt "), n.cast("string")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", n, line.alias("x"))
    kind = text.line_type(F.col("x"))
    corpus = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda r: r["x"]), "\n")
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(kind == "SERVICE").alias("services"), F.count_if(kind == "PACKAGING").alias("packings"), F.count_if(text.is_metadata(F.col("x"))).alias("metadata"), corpus.alias("corpus"))
    return counts.withColumn("goods", text.commercial_lines(F.col("corpus"))).drop("corpus")
