"""Roll-ups and allocations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.operators import rollup
from customsloom.plans.bindings import INVOICES, LINES, grams, invoices, lines, money
from customsloom.plans.registry import query

_COUNTRIES = "string_agg(DISTINCT country, ', ' ORDER BY country) AS countries_of_origin"
_SUMS = f"{money('sum(quantity)')} AS total_quantity, {money('sum(line_total)')} AS total_value, CASE WHEN sum(net_weight) > 0 THEN {grams('sum(net_weight)')} END AS total_net_weight, count(*) AS item_count"


@query(f"WITH {LINES} SELECT hs_code, preference, {_SUMS}, {_COUNTRIES} FROM lines GROUP BY hs_code, preference")
def tariff_rollup_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.by_preference(rollup.goods(lines(spark, sf_dir)))


@query(f"WITH {LINES} SELECT hs_code, {_SUMS}, {_COUNTRIES} FROM lines GROUP BY hs_code")
def tariff_rollup_hs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.by_code(rollup.goods(lines(spark, sf_dir)))


@query(f"""WITH {LINES} SELECT hs_code,
  count(*) FILTER (preference = 'YES') AS preferential_lines, coalesce({money("sum(line_total) FILTER (preference = 'YES')")}, 0) AS preferential_value, {grams("sum(net_weight) FILTER (preference = 'YES')")} AS preferential_weight,
  count(*) FILTER (preference = 'NO') AS non_preferential_lines, coalesce({money("sum(line_total) FILTER (preference = 'NO')")}, 0) AS non_preferential_value, {grams("sum(net_weight) FILTER (preference = 'NO')")} AS non_preferential_weight,
  count(*) FILTER (preference = 'NOT_DECLARED') AS unknown_lines, coalesce({money("sum(line_total) FILTER (preference = 'NOT_DECLARED')")}, 0) AS unknown_value, {grams("sum(net_weight) FILTER (preference = 'NOT_DECLARED')")} AS unknown_weight
  FROM lines GROUP BY hs_code""")
def preference_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.preference_buckets(rollup.goods(lines(spark, sf_dir)))


@query(f"WITH {LINES} SELECT invoice_id, {money('sum(line_total)')} AS total_value, {money('sum(quantity)')} AS total_quantity, {grams('coalesce(sum(net_weight), 100.0)')} AS total_net_weight FROM lines GROUP BY invoice_id")
def collapsed_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.collapsed_bucket(rollup.goods(lines(spark, sf_dir)), F.lit(100.0), "invoice_id")


@query(f"""WITH {LINES} SELECT invoice_id, count(*) AS total_goods_lines, count(DISTINCT hs_code || '|' || preference) AS unique_hs_codes, count(DISTINCT hs_code) AS distinct_hs_codes,
  {money('sum(line_total)')} AS total_invoice_value, {grams('sum(net_weight)')} AS total_net_weight, {_COUNTRIES} FROM lines GROUP BY invoice_id""")
def mrn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.declaration_summary(rollup.goods(lines(spark, sf_dir)), "invoice_id")


@query(f"""WITH {LINES}, r AS (SELECT invoice_id, hs_code, {money('sum(line_total)')} AS total_value FROM lines GROUP BY 1, 2),
  s AS (SELECT *, sum(total_value) OVER (PARTITION BY invoice_id) AS a, count(*) OVER (PARTITION BY invoice_id) AS n, row_number() OVER (PARTITION BY invoice_id ORDER BY hs_code) AS k FROM r),
  t AS (SELECT *, {grams('1000.0 * total_value / a')} AS share FROM s)
  SELECT invoice_id, hs_code, total_value, CASE WHEN n = 1 THEN 1000.0 WHEN k = n THEN
    {grams('1000.0 - coalesce(sum(share) OVER (PARTITION BY invoice_id ORDER BY hs_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} ELSE share END AS allocated_weight FROM t""")
def remainder_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions.numbers import round_money

    rows = rollup.goods(lines(spark, sf_dir)).groupBy("invoice_id", "hs_code").agg(round_money(F.sum("line_total")).alias("total_value"))
    return rollup.allocate(rows, F.lit(1000.0), "total_value", "hs_code", "invoice_id", name="allocated_weight")


@query(f"""WITH {LINES}, {INVOICES}, s AS (SELECT invoice_id, count(*) FILTER (preference = 'YES') AS y, count(*) FILTER (preference = 'NO') AS n,
    coalesce(sum(quantity) FILTER (preference = 'YES'), 0) AS yq, coalesce(sum(quantity) FILTER (preference = 'NO'), 0) AS nq, coalesce(sum(line_total) FILTER (preference = 'YES'), 0) AS yv,
    coalesce(sum(line_total) FILTER (preference = 'NO'), 0) AS nv, sum(net_weight) FILTER (preference = 'YES') AS yw, sum(net_weight) FILTER (preference = 'NO') AS nw FROM lines GROUP BY 1),
  t AS (SELECT s.*, CASE WHEN total_value > 0 AND yv + nv > 0 AND greatest(yv + nv, total_value) / least(yv + nv, total_value) > 1.5 THEN total_value / (yv + nv) ELSE 1.0 END AS f FROM s JOIN invoices USING (invoice_id) WHERE y + n > 0),
  u AS (SELECT *, {money('yv * f')} AS pv, {money('nv * f')} AS npv FROM t)
  SELECT invoice_id, y > 0 AND n > 0 AS is_mixed, yq AS preferential_quantity, pv AS preferential_value,
    coalesce({grams('yw')}, CASE WHEN pv + npv > 0 AND pv > 0 THEN {grams('500.0 * pv / (pv + npv)')} END) AS preferential_weight, nq AS non_preferential_quantity, npv AS non_preferential_value,
    coalesce({grams('nw')}, CASE WHEN pv + npv > 0 AND npv > 0 THEN {grams('500.0 * npv / (pv + npv)')} END) AS non_preferential_weight FROM u""")
def preferential_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = invoices(spark, sf_dir).select("invoice_id", F.col("total_value").alias("canonical_total"), F.lit(500.0).alias("shipment_weight"))
    return rollup.preferential_allocation(rollup.goods(lines(spark, sf_dir)), totals)


@query(f"""WITH {LINES}, {INVOICES}, s AS (SELECT invoice_id, sum(net_weight) AS r, sum(net_weight * greatest(quantity, 1)) AS u, max(CASE WHEN net_weight IS NOT NULL AND quantity > 1 THEN 1 ELSE 0 END) AS m FROM lines GROUP BY 1),
  t AS (SELECT s.*, CASE WHEN invoice_id % 2 = 0 THEN floor(total_value / 100) END AS g FROM s JOIN invoices USING (invoice_id))
  SELECT invoice_id, {grams('r')} AS raw_line_sum, {grams('u')} AS unit_adjusted_sum, {grams('CASE WHEN coalesce(g, 0) <= 0 AND m = 1 AND u > r * 1.2 THEN u ELSE r END')} AS net_weight_total,
    coalesce(g > 0 AND greatest(r, u) > g * 1.1, false) AS unit_weight_misuse FROM t""")
def line_weight_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = F.when(F.col("invoice_id") % 2 == 0, F.floor(F.col("total_value") / 100).cast("double"))
    return rollup.line_weights(lines(spark, sf_dir), invoices(spark, sf_dir).select("invoice_id", gross.alias("gross_weight")))


@query(f"WITH {LINES} SELECT country, count(*) AS line_count FROM lines GROUP BY country")
def lines_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.origin_countries(lines(spark, sf_dir))


@query(f"""WITH {LINES}, c AS (SELECT hs_code, CASE part_id % 3 WHEN 0 THEN 'KG' WHEN 1 THEN 'PCS' END AS unit, count(CASE part_id % 3 WHEN 0 THEN 'KG' WHEN 1 THEN 'PCS' END) AS n FROM
    (SELECT substr(hs_code, 1, 2) AS hs_code, part_id FROM lines) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY hs_code ORDER BY n DESC, unit IS NULL, unit) AS k FROM c)
  SELECT hs_code, coalesce(unit, 'PCS') AS unit FROM r WHERE k = 1""")
def unit_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("part_id") % 3 == 0, "KG").when(F.col("part_id") % 3 == 1, "PCS")
    return rollup.aggregation_unit(lines(spark, sf_dir).select(F.substring("hs_code", 1, 2).alias("hs_code"), unit.alias("unit")), "unit", "hs_code")


@query(f"WITH {LINES} SELECT hs_code, CASE WHEN count(DISTINCT preference) = 1 THEN max(preference) ELSE 'MIXED' END AS preference_status FROM lines GROUP BY hs_code")
def preference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.status_of(lines(spark, sf_dir), "hs_code")


@query(f"""WITH {LINES} SELECT hs_code, preference, count(*) AS traced_lines, {money('sum(line_total)')} AS traced_value FROM lines GROUP BY 1, 2""")
def rollup_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions.numbers import round_money

    own = rollup.goods(lines(spark, sf_dir))
    traced = rollup.traceability(rollup.by_preference(own), own)
    return traced.groupBy("hs_code", "preference").agg(F.count("*").alias("traced_lines"), round_money(F.sum("line_total")).alias("traced_value"))


#: Lines with services, data about the invoice and lacking codes; invoices wholly preferential, wholly not, or as they are, a third of them without weights.
_MIXED = f"""{LINES}, {INVOICES}, m AS (SELECT invoice_id, CASE WHEN part_id % 10 = 0 THEN 'Transport costs' WHEN part_id % 10 = 1 THEN 'Tel' ELSE description END AS description, quantity, line_total, CASE WHEN part_id % 13 > 0 THEN hs_code END AS hs_code, country,
    CASE invoice_id % 4 WHEN 0 THEN 'YES' WHEN 2 THEN 'NO' ELSE preference END AS preference, CASE WHEN invoice_id % 3 > 0 THEN net_weight END AS net_weight FROM lines),
  k AS (SELECT *, CASE WHEN description = 'Transport costs' THEN 'SERVICE' WHEN hs_code IS NULL OR description = 'Tel' THEN 'LINE' ELSE 'GOODS' END AS kind FROM m),
  d AS (SELECT invoice_id, CASE WHEN invoice_id % 5 > 0 THEN (100 + invoice_id % 50)::DOUBLE END AS ship, (120 + invoice_id % 50)::DOUBLE AS gross, CASE WHEN invoice_id % 7 > 0 THEN total_value END AS total FROM invoices)"""


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, key = F.col("part_id"), F.col("invoice_id")
    rows = lines(spark, sf_dir).withColumns({
        "description": F.when(part % 10 == 0, "Transport costs").when(part % 10 == 1, "Tel").otherwise(F.col("description")), "hs_code": F.when(part % 13 > 0, F.col("hs_code")),
        "preference": F.when(key % 4 == 0, "YES").when(key % 4 == 2, "NO").otherwise(F.col("preference")), "net_weight": F.when(key % 3 > 0, F.col("net_weight")),
    })
    documents = invoices(spark, sf_dir).select("invoice_id", F.when(key % 5 > 0, (100 + key % 50).cast("double")).alias("shipment_weight"), (120 + key % 50).cast("double").alias("gross_weight"), F.when(key % 7 > 0, F.col("total_value")).alias("canonical_total"))
    return rollup.tariff_groups(rows), documents


@query(f"""WITH {_MIXED}, g AS (SELECT invoice_id, hs_code, preference, sum(quantity) AS q, sum(line_total) AS v, sum(net_weight) AS w, count(*) AS n, string_agg(DISTINCT country, ', ' ORDER BY country) AS c FROM k WHERE kind = 'GOODS' GROUP BY 1, 2, 3),
  i AS (SELECT invoice_id, sum(q) AS q, sum(v) AS v, sum(w) AS w, sum(n) AS n, count(*) AS rows_, count(*) FILTER (preference = 'YES') AS y, count(*) FILTER (preference = 'NO') AS no, count(*) FILTER (preference = 'NOT_DECLARED') AS nd FROM g GROUP BY 1),
  c AS (SELECT invoice_id, string_agg(DISTINCT country, ', ' ORDER BY country) AS c FROM k WHERE kind = 'GOODS' GROUP BY 1),
  f AS (SELECT g.*, ship, i.v AS goods, y > 0 AND no > 0 AND ship IS NOT NULL AND i.w IS NULL AS mixed, ship IS NOT NULL AND i.w IS NULL AND (y = rows_ OR no = rows_) AS alone, nd = rows_ AS undeclared, {money('g.v')} AS tv FROM g JOIN i USING (invoice_id) LEFT JOIN d USING (invoice_id)),
  s AS (SELECT *, {grams('ship * tv / sum(tv) OVER (PARTITION BY invoice_id)')} AS share, row_number() OVER (PARTITION BY invoice_id ORDER BY hs_code) AS nth, count(*) OVER (PARTITION BY invoice_id) AS many FROM f),
  p AS (SELECT *, CASE WHEN many = 1 THEN {grams('ship')} WHEN nth = many THEN {grams('ship - coalesce(sum(share) OVER (PARTITION BY invoice_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} ELSE share END AS part FROM s)
  SELECT invoice_id, 'codes' AS section, hs_code, preference, {money('q')} AS total_quantity, tv AS total_value, CASE WHEN alone THEN {grams('ship * tv / goods')} WHEN w > 0 THEN {grams('w')} END AS total_net_weight, false AS weight_unavailable, n AS item_count, c AS countries_of_origin FROM p
  UNION ALL SELECT invoice_id, CASE preference WHEN 'YES' THEN 'preferential' WHEN 'NO' THEN 'non_preferential' ELSE 'unknown' END, hs_code, preference, {money('q')}, tv, CASE WHEN alone THEN part ELSE {grams('w')} END, mixed, n, c FROM p WHERE NOT undeclared
  UNION ALL SELECT invoice_id, 'non_preferential', 'NON_PREFERENTIAL_EXPORT', 'NOT_DECLARED', {money('q')}, {money('v')}, {grams('coalesce(w, ship)')}, false, n, c FROM i JOIN c USING (invoice_id) LEFT JOIN d USING (invoice_id) WHERE nd = rows_""")
def tariff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composed roll-up of every invoice with all its sections and the dealt weights."""
    return rollup.tariff_report(*_mixed(spark, sf_dir))


@query(f"""WITH {_MIXED} SELECT k.invoice_id, count(*) FILTER (kind <> 'SERVICE') AS total_goods_lines, count(DISTINCT hs_code || preference) FILTER (kind = 'GOODS') AS unique_hs_codes,
    {money("CASE WHEN any_value(total) > 0 THEN any_value(total) ELSE coalesce(sum(line_total) FILTER (kind = 'GOODS'), 0) END")} AS total_invoice_value, {grams("coalesce(sum(net_weight) FILTER (kind = 'GOODS'), any_value(ship))")} AS total_net_weight, {grams('any_value(gross)')} AS total_gross_weight,
    coalesce(string_agg(DISTINCT country, ', ' ORDER BY country) FILTER (kind = 'GOODS'), '') AS countries_of_origin, count(*) FILTER (kind = 'SERVICE') AS excluded_service_lines FROM k LEFT JOIN d USING (invoice_id) GROUP BY 1""")
def invoice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.invoice_summary(*_mixed(spark, sf_dir))
