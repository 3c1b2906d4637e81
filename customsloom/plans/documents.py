"""Second readings, facts of whole documents, issues and summaries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.functions.numbers import round_up
from customsloom.operators import documents, golden, recovery, scoring
from customsloom.plans.bindings import LINES, lines, table
from customsloom.plans.registry import query


def _r(x: str, n: int) -> str:
    return f"floor(({x}) * {10**n} + 0.5) / {10**n}"


def _orders(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), *(c.alias(n) for n, c in columns.items()))


_READ = """r AS (SELECT l_orderkey AS invoice_id, CASE WHEN l_linenumber % 9 = 8 THEN 'Tel. 041' WHEN l_linenumber % 7 = 6 THEN '' ELSE 'goods' END AS description, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS line_total,
  CASE WHEN l_partkey % 4 = 0 THEN '7318.15' WHEN l_partkey % 4 = 1 THEN 'none' WHEN l_partkey % 4 = 2 THEN '73181590' END AS code FROM lineitem),
  q AS (SELECT invoice_id, count(*) AS n, count(*) FILTER (description = 'goods' AND quantity IS NOT NULL) AS good, count(*) FILTER (description = 'Tel. 041') AS footer_rows, count(*) FILTER (code IN ('7318.15', '73181590')) AS coded FROM r GROUP BY 1),
  m AS (SELECT invoice_id, n AS lines, CAST(floor(good * 100.0 / n + 0.5) AS INTEGER) AS quality, footer_rows, CAST(floor(coded * 100.0 / n + 0.5) AS INTEGER) AS code_ratio FROM q)"""


def _second_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"), n.alias("position"), F.lit(None).cast("string").alias("item_code"), F.when(n % 9 == 8, "Tel. 041").when(n % 7 == 6, "").otherwise("goods").alias("description"), F.lit("SI").alias("country"),
        F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("quantity"), F.col("l_extendedprice").alias("line_total"), F.when(p % 4 == 0, "7318.15").when(p % 4 == 1, "none").when(p % 4 == 2, "73181590").alias("code"),
    )


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = recovery.line_quality(_second_reading(spark, sf_dir))
    totals = F.when(F.col("invoice_id") % 5 == 0, "FAIL").when(F.col("invoice_id") % 5 == 1, "WARNING").otherwise("PASS")
    after = F.when(F.col("invoice_id") % 8 != 0, "x")
    lost = recovery.lost_fields(invoice_number=(F.lit("n"), F.lit("n")), invoice_date=(F.lit("d"), after), incoterms=(F.when(F.col("invoice_id") % 3 == 0, "EXW"), F.lit(None).cast("string")))
    score, reasons, accepted = recovery.recovery_gate(F.col("lines"), F.col("quality"), F.col("footer_rows"), F.col("code_ratio"), F.col("totals"), F.col("lost"))
    rows = quality.withColumns({"totals": totals, "lost": lost})
    return rows.select("invoice_id", "lines", score.alias("score"), F.array_join(reasons, ",").alias("reasons"), accepted.alias("accepted"))


_GATE = f"""{_READ}, g AS (SELECT *, CASE invoice_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS totals, invoice_id % 8 = 0 AS ld, invoice_id % 3 = 0 AS li FROM m),
  s AS (SELECT *, CAST(floor(least(lines / 3.0::DOUBLE, 1.0) * 20 + CASE totals WHEN 'PASS' THEN 35 WHEN 'WARNING' THEN 10 ELSE 0 END + quality * 0.2::DOUBLE + CASE WHEN ld OR li THEN 0 ELSE 15 END + code_ratio * 0.1::DOUBLE + 0.5) AS INTEGER) AS score FROM g),
  gate AS (SELECT invoice_id, lines, score, concat_ws(',', CASE WHEN lines < 3 THEN 'TOO_FEW_LINES' END, CASE WHEN totals = 'FAIL' THEN 'TOTALS_FAIL' END, CASE WHEN footer_rows > 0 THEN 'FOOTER_ROWS' END, CASE WHEN ld THEN 'LOST_INVOICE_DATE' END, CASE WHEN li THEN 'LOST_INCOTERMS' END, CASE WHEN score < 70 THEN 'LOW_SCORE' END) AS reasons FROM s)"""


@query(f"WITH {_GATE} SELECT *, reasons = '' AS accepted FROM gate")
def recovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir)


@query(f"""WITH {_GATE}, a AS (SELECT l_orderkey AS invoice_id, count(*) FILTER (l_linenumber % 2 = 1 OR l_orderkey % 4 = 0) AS old, count(*) AS new FROM lineitem GROUP BY 1), t AS (SELECT a.*, reasons = '' AND new > old AS take FROM a JOIN gate USING (invoice_id))
  SELECT invoice_id, CASE WHEN take THEN new ELSE old END AS lines, take AS recovered FROM t WHERE take OR old > 0""")
def recovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first reading that missed every other line of most invoices, and a second one that replaces it where it may."""
    second = _second_reading(spark, sf_dir)
    first = second.where((F.col("position") % 2 == 1) | (F.col("invoice_id") % 4 == 0))
    return recovery.replaced(first, second, _gated(spark, sf_dir)).groupBy("invoice_id", "recovered").agg(F.count("*").alias("lines"))


@query("""WITH b AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, min(l_quantity) AS quantity, min(l_extendedprice) AS line_total FROM lineitem GROUP BY 1, 2)
  SELECT invoice_id, position, CASE WHEN position <= 6 THEN quantity ELSE quantity + 1 END AS quantity, line_total, position % 3 AS note, CASE WHEN position <= 6 AND position % 2 = 0 THEN 'quantity' ELSE '' END AS overwrites FROM (SELECT invoice_id, position, quantity, line_total FROM b)
  WHERE position <= 6 OR position % 2 = 0""")
def locked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine adds 1 to the quantity of even positions and writes a note; positions up to 6 are locked."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position")).agg(F.min("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("line_total"))
    even = F.col("position") % 2 == 0
    after = own.where((F.col("position") <= 6) | even).withColumns({"quantity": F.when(even, F.col("quantity") + 1).otherwise(F.col("quantity")), "note": F.col("position") % 3})
    out = recovery.locked(own.where("position <= 6"), after, ["invoice_id", "position"], ["quantity", "line_total"])
    return out.select("invoice_id", "position", "quantity", "line_total", "note", F.array_join("overwrites", ",").alias("overwrites"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 50 + 10)::DOUBLE END AS en, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 40 + 20)::DOUBLE END AS eg, CASE o_orderkey % 4 WHEN 1 THEN 'CALCULATED' WHEN 2 THEN 'OCR_TEXT' WHEN 3 THEN 'DOCUMENT' END AS src,
    CASE WHEN o_orderkey % 7 = 0 THEN 31.5::DOUBLE END AS dn, CASE WHEN o_orderkey % 11 = 0 THEN 44.0::DOUBLE END AS dg, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90)::DOUBLE END AS ln FROM orders),
  p AS (SELECT *, coalesce(eg, dg) AS gross FROM o), q AS (SELECT *, coalesce(src IN ('OCR_TEXT', 'DOCUMENT'), false) AS st FROM p), r AS (SELECT *, st OR (src IS NULL AND en IS NOT NULL AND NOT coalesce(en > gross, false)) AS own FROM q),
  s AS (SELECT *, CASE WHEN own THEN en WHEN dn IS NOT NULL THEN dn WHEN gross IS NULL AND ln > 0 THEN ln END AS net FROM r)
  SELECT id AS invoice_id, net, CASE WHEN own THEN coalesce(src, 'DOCUMENT') WHEN dn IS NOT NULL THEN 'OCR_TEXT' WHEN gross IS NULL AND ln > 0 THEN 'CALCULATED' END AS net_source, gross, CASE WHEN eg IS NOT NULL THEN 'DOCUMENT' WHEN dg IS NOT NULL THEN 'OCR_TEXT' END AS gross_source,
    (NOT own AND dn IS NULL AND gross IS NOT NULL AND coalesce(ln > gross * 1.1::DOUBLE, false)) OR (((en IS NOT NULL AND st) OR dn IS NOT NULL) AND coalesce(net > gross, false)) AS unit_weight_misuse FROM s""")
def weight_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    d = lambda x: x.cast("double")
    source = F.when(key % 4 == 1, "CALCULATED").when(key % 4 == 2, "OCR_TEXT").when(key % 4 == 3, "DOCUMENT")
    found = documents.weights(F.when(key % 3 > 0, d(key % 50 + 10)), F.when(key % 5 > 0, d(key % 40 + 20)), source, F.when(key % 7 == 0, 31.5), F.when(key % 11 == 0, 44.0), F.when(key % 2 == 0, d(key % 90)))
    return _orders(spark, sf_dir, **found)


@query("""WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 'SI' END AS ex, CASE o_orderkey % 5 WHEN 0 THEN ['SI', 'CH'] WHEN 1 THEN ['SI'] WHEN 2 THEN ['RS', 'SI'] ELSE [] END AS co, CASE o_orderkey % 3 WHEN 0 THEN 'SI' WHEN 1 THEN 'GB' END AS st, CASE WHEN o_orderkey % 2 = 0 THEN 'US' END AS pl FROM orders),
  p AS (SELECT *, CASE WHEN len(co) = 0 THEN NULL WHEN ex IS NULL THEN co[1] ELSE coalesce(list_filter(co, lambda c: c <> 'SI')[1], co[1]) END AS own, CASE WHEN st IS NOT NULL AND st IS DISTINCT FROM ex THEN st END AS named, CASE WHEN pl IS NOT NULL AND pl IS DISTINCT FROM ex THEN pl END AS place FROM o)
  SELECT id AS invoice_id, coalesce(own, named, place) AS country, CASE WHEN own IS NOT NULL THEN 'consignee' WHEN named IS NOT NULL THEN 'ocr_country_field' WHEN place IS NOT NULL THEN 'incoterms_place' ELSE 'unresolved' END AS source FROM p""")
def destination_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    s = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    consignee = F.when(key % 5 == 0, s("SI", "CH")).when(key % 5 == 1, s("SI")).when(key % 5 == 2, s("RS", "SI")).otherwise(s())
    country, source = documents.destination(consignee, F.when(key % 4 != 0, "SI"), F.when(key % 3 == 0, "SI").when(key % 3 == 1, "GB"), F.when(key % 2 == 0, "US"))
    return _orders(spark, sf_dir, country=country, source=source)


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_totalprice AS h0, CASE WHEN o_orderkey % 13 = 0 THEN 812.5::DOUBLE END AS ad, CASE WHEN o_orderkey % 7 = 0 THEN 900.0::DOUBLE END AS lb, CASE o_orderkey % 5 WHEN 0 THEN 50.0::DOUBLE WHEN 1 THEN o_totalprice WHEN 2 THEN 1000.0::DOUBLE END AS af,
    CASE WHEN o_orderkey % 4 = 0 THEN 1234.5::DOUBLE END AS tx, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS h, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice * 2 WHEN 1 THEN o_totalprice * 1.2::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 3 THEN 77.777::DOUBLE END AS ls, CASE WHEN o_orderkey % 8 = 0 THEN 1000.0::DOUBLE ELSE 900.0::DOUBLE END AS g, (o_orderkey % 2 * 10)::DOUBLE AS dc FROM orders),
  p AS (SELECT *, coalesce(ls, h, 0.0) AS ref FROM o), q AS (SELECT *, lb > 0 AND NOT (dc > 0 AND abs(lb - g) < 0.02) AS s2, af > 0 AND NOT (dc > 0 AND abs(af - g) < 0.02) AND NOT (ref > 0 AND af < ref * 0.9::DOUBLE AND ref >= af * 10) AS s3, tx > 0 AND NOT (dc > 0 AND abs(tx - g) < 0.02) AS s4, h > 0 AND NOT (dc > 0 AND abs(h - g) < 0.02) AS s6 FROM p),
  x AS (SELECT *, CASE WHEN ad > 0 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 WHEN s4 THEN 4 WHEN s6 AND ls > 0 THEN 5 WHEN s6 THEN 6 WHEN ls > 0 THEN 7 END AS step FROM q)
  SELECT id AS invoice_id, coalesce({_r('CASE step WHEN 1 THEN ad WHEN 2 THEN lb WHEN 3 THEN af WHEN 4 THEN tx WHEN 5 THEN CASE WHEN greatest(h, ls) > least(h, ls) * 1.5::DOUBLE THEN least(h, ls) ELSE h END WHEN 6 THEN h WHEN 7 THEN ls END', 2)}, 0.0) AS value, step FROM x""")
def invoice_value_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    t = F.col("o_totalprice")
    line_sum = F.when(key % 6 == 0, t * 2).when(key % 6 == 1, t * 1.2).when(key % 6 == 2, 0.0).when(key % 6 == 3, 77.777)
    field = F.when(key % 5 == 0, 50.0).when(key % 5 == 1, t).when(key % 5 == 2, 1000.0)
    value, step = documents.invoice_value(F.when(key % 13 == 0, 812.5), F.when(key % 7 == 0, 900.0), field, F.when(key % 4 == 0, 1234.5), F.when(key % 3 > 0, t), line_sum, F.when(key % 8 == 0, 1000.0).otherwise(900.0), (key % 2 * 10).cast("double"))
    return _orders(spark, sf_dir, value=value, step=step)


_TOTALS = [
    ("Amount   Discount   Total invoice amount\n  1.000,00   100,00   900,00", 900.0, None), ("Total invoice amount  V amount\n 55,50 9,99", 55.5, None), ("Net  Total invoice amount  Amount to be paid\n 70.00", 70.0, None), ("nothing", None, None),
    ("Discount  Total invoice amount  Amount to be paid\n 1,00 0,00 44,00\nTotal amount EUR: 44,00", None, 44.0), ("Gesamt EUR 1.234,50 dankend", None, 1234.5), ("eur amount: 12.00", None, 12.0), ("Amount EUR 0,00\ntotal EUR 8,10", None, 8.1),
]


@query("SELECT o_orderkey AS invoice_id, CAST(t AS DOUBLE) AS tabular, CAST(a AS DOUBLE) AS amount FROM orders JOIN (VALUES " + ", ".join(f"({i}, {'NULL' if t is None else t}, {'NULL' if a is None else a})" for i, (_, t, a) in enumerate(_TOTALS)) + f") v(i, t, a) ON o_orderkey % {len(_TOTALS)} = i")
def totals_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = _orders(spark, sf_dir, text=F.get(F.array(*(F.lit(t) for t, *_ in _TOTALS)), (key % len(_TOTALS)).cast("int")))
    return rows.select("invoice_id", documents.tabular_total(F.col("text")).alias("tabular"), documents.amount_eur(F.col("text")).alias("amount"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 90 + 1 AS q, '1AB' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 8, 'X') AS s FROM orders)
  SELECT id, CAST(q AS DOUBLE) AS quantity, s AS style, q * 2.5::DOUBLE AS line_total, 2.5::DOUBLE AS unit_price, CASE WHEN id % 3 = 0 THEN '62034231' END AS code, CASE WHEN id % 2 = 0 THEN 'Sri Lanka' END AS country FROM o""")
def style_rows_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that start with a quantity and a style, some with the price behind, and what the lines below a style say."""
    key = F.col("o_orderkey")
    q, style = key % 90 + 1, F.concat(F.lit("1AB"), F.lpad((key % 1000).cast("string"), 8, "X"))
    money = lambda x: F.regexp_replace(x.cast("decimal(12,2)").cast("string"), r"\.", ",")
    row = F.concat_ws(" ", q.cast("string"), F.lower(style), money(q * 2.5), F.when(key % 4 == 0, money(F.lit(2.5))))
    text = F.concat_ws("\n", F.lit("Style Description Total"), row, F.when(key % 3 == 0, "HS Code - 6203 42 31"), F.lit("woven"), F.when(key % 2 == 0, "Origin - Sri Lanka"), F.lit("Total 12,00"))
    docs = table(spark, sf_dir, "orders").select(key.alias("id"), text.alias("text"))
    found = documents.style_rows(docs).join(docs, "id")
    code, country = documents.style_block(F.col("text"), F.col("style"))
    return found.select("id", "quantity", "style", "line_total", round_up(F.col("unit_price"), 6).alias("unit_price"), code.alias("code"), country.alias("country"))


_KINDS = ["rule_based", "ai_generated", "hs_library", "user_edited"]


@query(f"""WITH {LINES}, l AS (SELECT *, ['rule_based', 'ai_generated', 'hs_library', 'user_edited'][CAST(part_id % 4 + 1 AS INTEGER)] AS src, row_number() OVER (PARTITION BY invoice_id ORDER BY position, part_id, line_total, country) AS k FROM lines),
  a AS (SELECT invoice_id, count(DISTINCT src) AS n, min(src) AS one, bool_or(src = 'user_edited') AS u, bool_or(src = 'hs_library') AS h, bool_or(src = 'ai_generated') AS g, list(DISTINCT country ORDER BY country) AS countries FROM l GROUP BY 1)
  SELECT invoice_id, CASE WHEN n = 1 THEN one WHEN u THEN 'user_edited' WHEN h THEN 'hs_library' WHEN g THEN 'ai_generated' ELSE 'rule_based' END AS description_source, array_to_string(countries, ', ') AS country FROM a""")
def description_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of each invoice's description, and its countries rebuilt from all its lines."""
    own = lines(spark, sf_dir).withColumn("src", F.get(F.array(*(F.lit(x) for x in _KINDS)), (F.col("part_id") % 4).cast("int")))
    rows = own.groupBy("invoice_id").agg(F.collect_list("src").alias("sources"), F.array_sort(F.collect_set("position")).alias("source_positions"), F.array(F.min("country")).alias("countries"))
    rebuilt = documents.rebuilt_origins(rows, own, ["invoice_id"])
    return rebuilt.select("invoice_id", documents.description_source(F.col("sources")).alias("description_source"), "country")


@query(f"""WITH {LINES}, l AS (SELECT ['rule_based', 'ai_generated', 'hs_library', 'user_edited'][CAST(part_id % 4 + 1 AS INTEGER)] AS description_source FROM lines UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'user_edited' ELSE 'rule_based' END FROM orders)
  SELECT description_source, count(*) AS rows FROM l GROUP BY 1""")
def description_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    own = lines(spark, sf_dir).select(F.get(F.array(*(F.lit(x) for x in _KINDS)), (F.col("part_id") % 4).cast("int")).alias("description_source"))
    return documents.source_counts(own, _orders(spark, sf_dir, description_source=F.when(key % 2 == 0, "user_edited").otherwise("rule_based")))


@query("""WITH i AS (SELECT l_orderkey AS invoice_id, l_linenumber AS position, min(l_partkey) AS value FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY position) AS ord FROM i),
  w AS (SELECT o_orderkey AS invoice_id, unnest([1, 2, 3]) AS position FROM orders), a AS (SELECT * FROM o WHERE position % 2 = 1)
  SELECT w.invoice_id, w.position, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'position' WHEN b.value IS NOT NULL THEN 'ordinal' ELSE 'none' END AS how, CASE WHEN x.value IS NOT NULL AND x.value % 10 IN (1, 4) THEN 'NO' ELSE 'YES' END AS preference
  FROM w LEFT JOIN a ON a.invoice_id = w.invoice_id AND a.position = w.position LEFT JOIN o b ON b.invoice_id = w.invoice_id AND b.ord = w.position LEFT JOIN (SELECT w.invoice_id, w.position, coalesce(a.value, b.value) AS value FROM w LEFT JOIN a ON a.invoice_id = w.invoice_id AND a.position = w.position LEFT JOIN o b ON b.invoice_id = w.invoice_id AND b.ord = w.position) x ON x.invoice_id = w.invoice_id AND x.position = w.position""")
def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of positions 1 to 3, by position where one is known (odd ones), else by ordinal; styles on the exclusion list have no preference."""
    key = F.col("o_orderkey")
    from customsloom.operators import reconcile

    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("p")).agg(F.min("l_partkey").alias("value"))
    items = reconcile.renumber(own, "invoice_id", ["p"], "ord").withColumn("position", F.when(F.col("p") % 2 == 1, F.col("p"))).drop("p")
    wanted = table(spark, sf_dir, "orders").select(key.alias("invoice_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("position"))
    found = documents.item_at(wanted, items).withColumns({"style": F.col("value") % 10, "preference": F.lit("YES")})
    marked = table(spark, sf_dir, "orders").select(key.alias("invoice_id"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(4)).cast("array<bigint>")).alias("style"))
    return documents.excluded_lines(found, marked).drop("style")


_MESSAGES = ["Net weight not found", "HS code of line 3 missing", "No country of origin", "destination is missing", "Invoice total differs significantly", "position 3 qty mismatch", "Duplicate position number on invoice", "Duplicate position number 4", "position sequence gap at 7", "Position 4: value mismatch", "Invalid HS code 12", "all is well", "missing position number"]
_INFERRED = ["MISSING_NET_WEIGHT", "MISSING_HS_CODE", "MISSING_COUNTRY_OF_ORIGIN", "MISSING_DESTINATION", "TOTAL_VALUE_PARSING_ERROR", "POSITION_QTY_MISMATCH", "DUPLICATE_POSITION_NUMBER_ON_INVOICE", "DUPLICATE_POSITION_NUMBER", "POSITION_SEQUENCE_GAP", "POSITION_VALUE_MISMATCH", "INVALID_HS_FORMAT", None, "MISSING_POSITION_NUMBER"]
_SEVERITY = ["WARNING", "WARNING", None, "CRITICAL", "WARNING", "CRITICAL", "WARNING", None, "WARNING", "CRITICAL", "CRITICAL", None, None]


def _tag(xs: list) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"


@query(f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 13 + 1 AS INTEGER) AS m, CASE o_orderkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS kind, o_orderkey % 4 = 0 AS own FROM orders)
  SELECT id AS invoice_id, CASE WHEN own THEN 'LTSD_REFERENCED' ELSE {_tag(_INFERRED)}[m] END AS code, CASE WHEN own THEN 'INFO' ELSE coalesce({_tag(_SEVERITY)}[m], CASE kind WHEN 'error' THEN 'CRITICAL' WHEN 'warning' THEN 'WARNING' ELSE 'INFO' END) END AS severity FROM o""")
def issue_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    message = F.get(F.array(*(F.lit(m) for m in _MESSAGES)), (key % len(_MESSAGES)).cast("int"))
    kind = F.when(key % 3 == 0, "error").when(key % 3 == 1, "warning").otherwise("info")
    rows = _orders(spark, sf_dir, code=scoring.issue_code(F.when(key % 4 == 0, "LTSD_REFERENCED"), message), kind=kind)
    return rows.select("invoice_id", "code", scoring.issue_severity(F.col("code"), F.col("kind")).alias("severity"))


_FOUND = """i AS (SELECT o_orderkey AS id, 'A' AS code, 'error' AS kind, true AS critical FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'B', 'warning', false FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'B', 'warning', false FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 'C', 'warning', true FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'D', 'info', false FROM orders WHERE o_orderkey % 3 = 0)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders, out = table(spark, sf_dir, "orders"), None
    for n, code, kind, critical in ((7, "A", "error", True), (2, "B", "warning", False), (4, "B", "warning", False), (5, "C", "warning", True), (3, "D", "info", False)):
        part = orders.where(key % n == 0).select(key.alias("invoice_id"), F.lit(code).alias("code"), F.lit(kind).alias("kind"), F.lit(critical).alias("critical"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_FOUND}, j AS (SELECT * FROM i WHERE NOT (code = 'C' AND id % 10 = 0)), p AS (SELECT *, CASE WHEN kind = 'error' THEN 18 WHEN kind = 'warning' AND critical THEN 12 WHEN kind = 'warning' THEN 3 ELSE 0 END AS c FROM j),
  s AS (SELECT id, sum(c) AS costs FROM (SELECT id, code, max(c) AS c FROM p GROUP BY 1, 2) GROUP BY 1), m AS (SELECT id, bool_or(critical AND kind <> 'info') AS blocked, sum(CASE WHEN NOT critical AND kind <> 'info' THEN c ELSE 0 END) AS minor FROM p GROUP BY 1),
  o AS (SELECT o_orderkey AS id, coalesce(costs, 0) AS costs, coalesce(blocked, false) AS blocked, coalesce(minor, 0) AS minor, 80 - coalesce(costs, 0) - CASE WHEN o_orderkey % 9 = 0 THEN 8 ELSE 0 END AS b FROM orders LEFT JOIN s ON s.id = o_orderkey LEFT JOIN m ON m.id = o_orderkey),
  f AS (SELECT id, CASE WHEN NOT blocked AND id % 6 <> 1 AND id % 4 <> 3 THEN greatest(b, 95 - minor) ELSE b END AS x FROM o)
  SELECT id AS invoice_id, CAST(greatest(0, least(100, CASE WHEN id % 6 = 1 AND id % 11 = 0 THEN greatest(x, 90) ELSE x END)) AS INTEGER) AS readiness_score FROM f""")
def readiness_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness from a base of 80 with its floors; issue C is resolved for every tenth document."""
    key = F.col("o_orderkey")
    docs = _orders(spark, sf_dir, declared=key % 9 == 0, eur1=F.lit(True), authorised=F.lit(False), codes=F.when(key % 6 == 1, 0).otherwise(4), export_ready=key % 4 != 3, confirmed=F.lit(True), foundation=key % 11 == 0, only_classification=F.lit(True))
    resolved = _orders(spark, sf_dir, code=F.lit("C")).where("invoice_id % 10 = 0")
    return scoring.adjusted_readiness(scoring.without_resolved(_found(spark, sf_dir), resolved), docs, base=80.0)


@query("""SELECT o_orderkey AS invoice_id, CASE WHEN o_orderkey % 4 = 0 THEN 'one|two' WHEN o_orderkey % 4 = 1 THEN 'a|b|c' WHEN o_orderkey % 4 = 2 THEN 'Missing: weight' ELSE '' END AS reasons FROM orders""")
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    s = lambda *xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    own = F.when(key % 4 == 0, s("one", " ", "Required declaration data available", "two")).otherwise(s("Required declaration data available"))
    messages = F.when(key % 4 == 1, s("a ", "b", "a", "c", "d")).otherwise(s(""))
    return _orders(spark, sf_dir, reasons=F.array_join(scoring.top_reasons(own, messages, F.when(key % 4 == 2, s("", "weight", "value")).otherwise(s())), "|"))


@query("""WITH l AS (SELECT l_orderkey AS id, count(*) AS n, bool_or(l_quantity < 3) AS z FROM lineitem GROUP BY 1), i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0)
  SELECT o_orderkey AS invoice_id, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'DESCRIPTION_ARTIFACT' END, CASE WHEN coalesce(n, 0) <> 4 THEN 'EXTRACTION_LINE_COUNT_MISMATCH' END, CASE WHEN z AND o_orderkey % 2 = 0 THEN 'ZERO_QTY_WITH_VALUE' END, CASE WHEN z AND o_orderkey % 2 = 1 THEN 'ZERO_VALUE_WITH_QTY' END) AS failures
  FROM orders LEFT JOIN l ON l.id = o_orderkey""")
def golden_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    k, low = F.col("l_orderkey"), F.col("l_quantity") < 3
    own = table(spark, sf_dir, "lineitem").select(k.alias("invoice_id"), F.when(low & (k % 2 == 0), 0.0).otherwise(F.col("l_quantity")).alias("quantity"), F.when(low & (k % 2 == 1), 0.0).otherwise(F.col("l_extendedprice")).alias("line_total"))
    issues = _orders(spark, sf_dir, code=F.when(key % 5 == 0, "DESCRIPTION_ARTIFACT").otherwise("OTHER"))
    return scoring.golden_gate(own, issues, _orders(spark, sf_dir, source_lines=F.lit(4))).select("invoice_id", F.array_join("failures", ",").alias("failures"))


@query("""SELECT o_orderkey AS invoice_id, 'total' AS field, '5|' || CASE WHEN o_orderkey % 3 = 0 THEN '6' ELSE '5' END || '|' || CASE WHEN o_orderkey % 4 = 0 THEN '7' ELSE '5' END AS shown, 'csv|pdf|screen' AS names FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0""")
def surface_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    shown = lambda c: _orders(spark, sf_dir, field=F.lit("total"), value=c)
    return scoring.surfaces("invoice_id", csv=shown(F.lit(5)), pdf=shown(F.when(key % 3 == 0, 6).otherwise(5)), screen=shown(F.when(key % 4 == 0, 7).otherwise(5)))


@query(f"""WITH e AS (SELECT event_type AS category, value, event_id AS k FROM events)
  SELECT count(*) AS total_cases, count(*) FILTER (k % 11 = 0) AS errors, {_r('count(*) FILTER (k % 11 <> 0) * 1.0::DOUBLE / count(*)', 4)} AS success_rate, {_r('avg(k % 100) FILTER (k % 11 <> 0)', 4)} AS average_confidence,
    {_r('count(*) FILTER (k % 2 = 0) * 1.0::DOUBLE / count(*)', 4)} AS used_rate, {_r('count(*) FILTER (k % 3 = 0) * 1.0::DOUBLE / count(*)', 4)} AS candidates_rate, {_r('count(*) FILTER (k % 5 = 0) * 1.0::DOUBLE / count(*)', 4)} AS injected_rate, {_r('count(*) FILTER (k % 10 = 0) * 1.0::DOUBLE / count(*)', 4)} AS won_rate FROM e""")
def live_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    cases = table(spark, sf_dir, "events").select((k % 11 != 0).alias("success"), (k % 100).cast("double").alias("confidence"), F.when(k % 11 == 0, "failed").alias("error"), *((k % n == 0).alias(c) for c, n in (("used", 2), ("candidates", 3), ("injected", 5), ("won", 10))))
    return golden.live_summary(cases)
