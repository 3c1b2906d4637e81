"""Freight, landed cost and routes over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.functions import country, geo
from customsloom.functions.numbers import round_money, round_to_5, round_up
from customsloom.operators import pricing, scoring
from customsloom.plans.bindings import table
from customsloom.plans.registry import ORACLES, query


def _r(x: str, n: int) -> str:
    return f"floor(({x}) * {10**n} + 0.5) / {10**n}"


def _five(x: str) -> str:
    y = f"(({x}) / 5)"
    return f"5 * CASE WHEN {y} - floor({y}) > 0.5 THEN floor({y}) + 1 WHEN {y} - floor({y}) < 0.5 THEN floor({y}) ELSE floor({y}) + floor({y}) % 2 END"


def _even(x: str) -> str:
    y = f"({x})"
    return f"CASE WHEN {y} - floor({y}) > 0.5 THEN floor({y}) + 1 WHEN {y} - floor({y}) < 0.5 THEN floor({y}) ELSE floor({y}) + floor({y}) % 2 END"


_TRIPS = """trips AS (SELECT o_orderkey AS request_id, CAST(20 + o_orderkey % 1480 AS DOUBLE) AS distance_km, CAST(o_orderkey * 37 % 24000 AS DOUBLE) AS weight_kg, CAST(o_orderkey % 34 AS DOUBLE) AS pallets, CAST(o_orderkey % 137 AS DOUBLE) / 10 AS loading_meters FROM orders),
  history AS (SELECT p_partkey AS transport_id, CAST(10 + p_partkey * 13 % 2000 AS DOUBLE) AS distance_km, CAST(p_partkey * 91 % 24000 AS DOUBLE) AS weight_kg, CAST(p_partkey % 34 AS DOUBLE) AS pallets, CAST(p_partkey * 7 % 137 AS DOUBLE) / 10 AS loading_meters, p_retailprice AS price FROM part)"""


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), (20 + k % 1480).cast("double").alias("distance_km"), (k * 37 % 24000).cast("double").alias("weight_kg"), (k % 34).cast("double").alias("pallets"), ((k % 137).cast("double") / 10).alias("loading_meters"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("transport_id"), (10 + k * 13 % 2000).cast("double").alias("distance_km"), (k * 91 % 24000).cast("double").alias("weight_kg"), (k % 34).cast("double").alias("pallets"), ((k * 7 % 137).cast("double") / 10).alias("loading_meters"), F.col("p_retailprice").alias("price"))


_NEAR = f"""{_TRIPS}, n AS (SELECT request_id, transport_id, {_r('abs(h.distance_km - t.distance_km) + abs(h.weight_kg - t.weight_kg) / 100 + abs(h.pallets - t.pallets) * 10 + abs(h.loading_meters - t.loading_meters) * 10', 6)} AS score, price
    FROM trips t JOIN history h ON h.distance_km >= t.distance_km * 0.5 AND h.distance_km <= t.distance_km * 1.5),
  best AS (SELECT request_id, transport_id, score, price AS similar_price FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, transport_id) AS k FROM n) WHERE k = 1)"""


@query(f"WITH {_NEAR} SELECT request_id, transport_id, {_r('score', 3)} AS score, similar_price FROM best")
def freight_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a request."""
    near = pricing.nearest_price(_trips(spark, sf_dir), _history(spark, sf_dir))
    return near.select("request_id", "transport_id", round_up(F.col("score"), 3).alias("score"), "similar_price")


_FTL = "least(greatest(distance_km * greatest(1.35 * fuel / 1.55, 1.7) * (1.0 + pallets * 0.05 + weight_kg / 1000 * 0.03 + loading_meters * 0.06), distance_km * 1.6), distance_km * 2.4)"
_FALL = "(distance_km * 0.18 + weight_kg * 0.02 + pallets * 10 + loading_meters * 8)"


@query(f"""WITH {_NEAR}, f AS (SELECT t.*, similar_price, (CASE t.request_id % 3 WHEN 0 THEN 1.70 WHEN 1 THEN 1.98 ELSE 1.75 END + CASE t.request_id % 2 WHEN 0 THEN 1.82 ELSE 1.75 END) / 2 AS fuel FROM trips t JOIN best USING (request_id)),
  p AS (SELECT *, {_FALL} AS fb, {_FTL} AS ftl FROM f), q AS (SELECT *, CASE WHEN request_id % 20 = 0 THEN ftl WHEN distance_km < 180 THEN least(greatest((0.6 * similar_price + 0.4 * fb) * (1 + pallets * 0.04 + weight_kg / 1000 * 0.03 + loading_meters * 0.05), 60.0), 180.0) ELSE 0.6 * similar_price + 0.4 * fb END AS cost FROM p),
  m AS (SELECT *, {_r('cost * (1 + CASE WHEN cost < 200 THEN 0.20 WHEN cost <= 500 THEN 0.10 ELSE 0.05 END)', 6)} AS c FROM q) SELECT request_id, {_r('cost', 2)} AS cost, {_five('c')} AS price FROM m""")
def freight_price_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir, _trips(spark, sf_dir))


def _tiers(spark: SparkSession, sf_dir: str, trips: DataFrame) -> DataFrame:
    rows = trips.join(pricing.nearest_price(trips, _history(spark, sf_dir)), "request_id")
    k, d, w, p, m = (F.col(c) for c in ("request_id", "distance_km", "weight_kg", "pallets", "loading_meters"))
    fuel = pricing.corridor_fuel(F.when(k % 3 == 0, "SI").when(k % 3 == 1, "DE").otherwise("XX"), F.when(k % 2 == 0, "AT").otherwise("XX"))
    cost = F.when(k % 20 == 0, pricing.full_load(d, fuel, p, w, m)).otherwise(pricing.blended(d, F.col("similar_price"), F.lit(None).cast("double"), pricing.part_load(d, w, p, m), p, w, m))
    rows = rows.select("request_id", cost.alias("c"))
    return rows.select("request_id", round_money(F.col("c")).alias("cost"), round_to_5(round_up(pricing.markup(F.col("c")), 6)).alias("price"))


@query(ORACLES["freight_nearest"])
def freight_nearest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freight_nearest(spark, sf_dir)


@query(ORACLES["freight_price_tiers"])
def freight_price_tiers_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freight_price_tiers(spark, sf_dir)


_CODES = "'DE', 'FR', 'SI', 'US', 'CH'"


@query(f"""WITH o AS (SELECT o_orderkey AS invoice_id, o_totalprice AS g, CAST(o_orderkey % 500 AS DOUBLE) AS t, list_extract([{_CODES}], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS a, list_extract([{_CODES}], CAST(o_custkey % 5 + 1 AS INTEGER)) AS b,
    CASE o_orderkey % 3 WHEN 0 THEN 12.0 WHEN 1 THEN 8.0 ELSE 4.2 END AS dr FROM orders),
  r AS (SELECT *, CASE WHEN a IN ('DE', 'FR', 'SI') AND b IN ('DE', 'FR', 'SI') THEN 'INTRA_EU' WHEN b IN ('DE', 'FR', 'SI') THEN 'IMPORT' WHEN a IN ('DE', 'FR', 'SI') THEN 'EXPORT' ELSE 'THIRD_COUNTRY' END AS route FROM o),
  d AS (SELECT *, {_r("g * CASE WHEN route = 'INTRA_EU' THEN 0.0 ELSE dr END / 100", 2)} AS duty FROM r), v AS (SELECT *, {_r('g + t + duty', 2)} AS cv FROM d),
  x AS (SELECT *, CASE WHEN route = 'IMPORT' THEN {_r("cv * CASE b WHEN 'DE' THEN 19.0 WHEN 'FR' THEN 20.0 ELSE 22.0 END / 100", 2)} ELSE 0.0 END AS vat FROM v)
  SELECT invoice_id, route, duty AS duty_amount, cv AS customs_value, vat AS vat_amount, {_r('duty + vat', 2)} AS import_charges, {_r('cv + vat', 2)} AS landed_cost FROM x""")
def landed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n: F.element_at(F.array(*(F.lit(c) for c in ("DE", "FR", "SI", "US", "CH"))), (n % 5 + 1).cast("int"))
    code = F.when(k % 3 == 0, "61091000").when(k % 3 == 1, "64039100").otherwise("11111111")
    rows = table(spark, sf_dir, "orders").select(k.alias("invoice_id"), F.col("o_totalprice").alias("g"), (k % 500).cast("double").alias("t"), pick(k).alias("a"), pick(F.col("o_custkey")).alias("b"), code.alias("code"))
    rows = rows.withColumn("route", country.route_type(F.col("a"), F.col("b")))
    parts = pricing.landed_cost(F.col("g"), F.col("t"), pricing.duty_rate(F.col("code"), F.col("route")), country.vat_rate(F.col("b")), F.col("route") == "IMPORT")
    return rows.select("invoice_id", "route", *(c.alias(n) for n, c in parts.items()))


@query(f"""WITH o AS (SELECT o_orderkey AS id, list_extract(['VAN', 'TRUCK_7_5T', 'TRUCK_13_6M', 'MEGA_TRAILER'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS v, CAST(o_orderkey % 900 AS DOUBLE) AS w, CAST(o_orderkey % 13 AS DOUBLE) AS l, o_orderkey % 97 AS a, o_custkey % 97 AS b FROM orders)
  SELECT id AS request_id, v AS vehicle, {_r("(CASE v WHEN 'VAN' THEN 85 + w * 0.18 WHEN 'TRUCK_7_5T' THEN 145 + w * 0.12 WHEN 'TRUCK_13_6M' THEN 260 + w * 0.08 ELSE 310 + w * 0.075 END + l * 95) * CASE WHEN id % 11 = 0 THEN 1.25 ELSE greatest(1.0, least(3.8, 1 + abs(a - b) / 18.0)) END", 2)} AS cost FROM o""")
def transport_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    vehicle = F.element_at(F.array(*(F.lit(v) for v in pricing.VEHICLES)), (k % 4 + 1).cast("int"))
    postal = lambda n: F.concat(F.lit("D-"), F.lpad((n % 97).cast("string"), 2, "0"), F.lit("123"))
    pickup = F.when(k % 11 == 0, "none").otherwise(postal(k))
    cost = pricing.transport_estimate(vehicle, (k % 900).cast("double"), (k % 13).cast("double"), pickup, postal(F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), vehicle.alias("vehicle"), cost.alias("cost"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 300 > 245 OR o_orderkey % 1500 > 1360 THEN 'special_transport' WHEN o_orderkey % 310 > 270 THEN 'restricted' ELSE 'fits' END AS fit,
  CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 ELSE o_orderkey % 3 END WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 ELSE 0 END AS package_count,
  CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN 'CT' WHEN o_orderkey % 3 > 0 THEN 'PAL' WHEN o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 THEN 'CT' WHEN o_orderkey % 7 > 0 THEN 'COLLI' ELSE '' END AS package_type,
  o_orderkey % 7 > 0 AND o_orderkey % 3 > 0 AND o_orderkey % 2 = 1 AS package_review FROM orders""")
def cargo_and_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    count, kind, review = scoring.packages(k % 7, k % 3, F.when(k % 2 == 0, "ct"))
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), scoring.cargo_fit(k % 1500, k % 300, k % 310).alias("fit"), F.coalesce(count, F.lit(0)).alias("package_count"), F.coalesce(kind, F.lit("")).alias("package_type"), review.alias("package_review"))


def _hav(a: str, b: str, c: str, d: str, radius: float) -> str:
    return f"2 * {radius} * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


_NATIONS = "n AS (SELECT n_nationkey AS k, 35.0 + n_nationkey * 1.3 AS lat, -9.0 + n_nationkey * 1.7 AS lon FROM nation)"


@query(f"WITH {_NATIONS} SELECT a.k AS origin, b.k AS destination, {_r(_hav('a.lat', 'a.lon', 'b.lat', 'b.lon', 6371.0), 4)} AS km FROM n a JOIN n b ON a.k < b.k")
def haversine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (35.0 + F.col("n_nationkey") * 1.3).alias("lat"), (-9.0 + F.col("n_nationkey") * 1.7).alias("lon"))
    a, b = n.alias("a"), n.alias("b")
    km = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), geo.FREIGHT_RADIUS)
    return a.join(b, F.col("a.k") < F.col("b.k")).select(F.col("a.k").alias("origin"), F.col("b.k").alias("destination"), round_up(km, 4).alias("km"))


_EDGES = "(VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip([geo.SLOVENIA[-1], *geo.SLOVENIA[:-1]], geo.SLOVENIA, strict=True)) + ") e(alat, alon, blat, blon)"


@query(f"""WITH p AS (SELECT c_custkey AS id, 45.2 + (c_custkey % 40) * 0.05 AS lat, 13.2 + (c_custkey * 7 % 70) * 0.05 AS lon FROM customer)
  SELECT id, count(*) FILTER (((blon > lon) <> (alon > lon)) AND lat < (alat - blat) * (lon - blon) / CASE WHEN alon = blon THEN 1 ELSE alon - blon END + blat) % 2 = 1 AS inside FROM p, {_EDGES} GROUP BY id""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), geo.in_polygon(45.2 + (k % 40) * 0.05, 13.2 + (k * 7 % 70) * 0.05).alias("inside"))


_ROUTES = """pts AS (SELECT s_suppkey AS route_id, CAST(i AS INTEGER) AS ord, 45.5 + (s_suppkey % 10) * 0.1 + i * 0.07 AS lat, 13.0 + i * 0.45 + (s_suppkey % 7) * 0.02 AS lon FROM supplier, generate_series(0, 8) t(i))"""
_LEGS = f"""{_ROUTES}, l0 AS (SELECT route_id, ord AS seg, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY ord)),
  l1 AS (SELECT *, {_hav('lat1', 'lon1', 'lat2', 'lon2', 6371.0088)} AS km FROM l0 WHERE lat2 IS NOT NULL), legs AS (SELECT *, sum(km) OVER (PARTITION BY route_id ORDER BY seg ROWS UNBOUNDED PRECEDING) AS end_km FROM l1),
  tot AS (SELECT route_id, max(end_km) AS total FROM legs GROUP BY 1), sm0 AS (SELECT route_id, total, unnest(generate_series(0, greatest(CAST(ceil(total / 10.0) AS INTEGER) - 1, 0))) AS sample FROM tot), sm AS (SELECT *, least(10.0, total - sample * 10.0) AS d, sample * 10.0 + least(10.0, total - sample * 10.0) / 2 AS pos FROM sm0),
  hit AS (SELECT sm.route_id, sample, d, pos, end_km - km AS s, end_km, lat1, lon1, lat2, lon2, row_number() OVER (PARTITION BY sm.route_id, sample ORDER BY seg) AS k FROM sm JOIN legs ON sm.route_id = legs.route_id AND pos >= end_km - km AND pos <= end_km),
  mid AS (SELECT route_id, sample, d, lat1 + (lat2 - lat1) * (pos - s) / (end_km - s) AS lat, lon1 + (lon2 - lon1) * (pos - s) / (end_km - s) AS lon FROM hit WHERE k = 1)"""


def _route_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("ord"), F.col("route_id")
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("ord"))
    points = points.select("route_id", "ord", (45.5 + (k % 10) * 0.1 + i * 0.07).alias("lat"), (13.0 + i * 0.45 + (k % 7) * 0.02).alias("lon"))
    return geo.resample(geo.segments(points), 10.0)


@query(f"WITH {_LEGS} SELECT route_id, CAST(sample AS INTEGER) AS sample, {_r('d', 4)} AS distance_km, {_r('lat', 4)} AS lat, {_r('lon', 4)} AS lon FROM mid")
def route_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_samples(spark, sf_dir).select("route_id", "sample", *(round_up(F.col(c), 4).alias(c) for c in ("distance_km", "lat", "lon")))


_INSIDE = f"(SELECT count(*) FILTER (((blon > lon) <> (alon > lon)) AND lat < (alat - blat) * (lon - blon) / CASE WHEN alon = blon THEN 1 ELSE alon - blon END + blat) % 2 = 1 FROM {_EDGES})"
_KINDS = f"{_LEGS}, kd AS (SELECT *, CASE WHEN {_INSIDE} THEN 'domestic' ELSE 'foreign' END AS kind FROM mid)"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_samples(spark, sf_dir).withColumn("kind", F.when(geo.in_polygon(F.col("lat"), F.col("lon")), "domestic").otherwise("foreign"))


@query(f"""WITH {_KINDS}, c AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY route_id ORDER BY sample) THEN 0 ELSE 1 END AS ch FROM kd), i AS (SELECT *, sum(ch) OVER (PARTITION BY route_id ORDER BY sample ROWS UNBOUNDED PRECEDING) AS island FROM c)
  SELECT route_id, CAST(island AS BIGINT) AS island, kind, count(*) AS samples, {_r('sum(d)', 3)} AS km FROM i GROUP BY 1, 2, 3""")
def route_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.islands(_kinds(spark, sf_dir), "kind").groupBy("route_id", "island", "kind").agg(F.count("*").alias("samples"), round_up(F.sum("distance_km"), 3).alias("km"))


@query(f"""WITH {_KINDS}, s AS (SELECT route_id, sum(d) AS t, sum(CASE WHEN kind = 'domestic' THEN d ELSE 0 END) AS h, 500.0 + route_id AS c FROM kd GROUP BY 1)
  SELECT route_id, {_r('t', 2)} AS total_km, {_r('h', 2)} AS domestic_km, {_r('greatest(t - h, 0)', 2)} AS foreign_km, {_r('h / t * 100', 1)} AS domestic_percent, {_even('h / t * c')} AS domestic_cost, {_even('c')} - {_even('h / t * c')} AS foreign_cost FROM s""")
def route_cost_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _kinds(spark, sf_dir).groupBy("route_id").agg(F.sum("distance_km").alias("t"), F.sum(F.when(F.col("kind") == "domestic", F.col("distance_km")).otherwise(0.0)).alias("h"))
    parts = pricing.cost_split(F.col("t"), F.col("h"), 500.0 + F.col("route_id"))
    return sums.select("route_id", *(c.alias(n) for n, c in parts.items()))
