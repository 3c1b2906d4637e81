"""Countries of points and routes: every nation is a star of twelve corners, which overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from customsloom.functions import geo
from customsloom.functions.numbers import round_up
from customsloom.operators import places
from customsloom.plans.bindings import table
from customsloom.plans.pricing import _LEGS
from customsloom.plans.registry import query

#: Corners of the stars: eastwards and northwards, in eighths of a degree for each unit of a corner's length.
_CORNERS = [(8, 0), (7, 4), (4, 7), (0, 8), (-4, 7), (-7, 4), (-8, 0), (-7, -4), (-4, -7), (0, -8), (4, -7), (7, -4)]
STEP_KM = 10.0

_STARS = f"""star AS (SELECT n_nationkey AS country, j, 44.0::DOUBLE + (n_nationkey % 5) * 1.1::DOUBLE + dy * (4 + (n_nationkey * 7 + j * 5) % 4) / 64.0::DOUBLE AS lat, 12.0::DOUBLE + (n_nationkey // 5) * 1.3::DOUBLE + dx * (4 + (n_nationkey * 7 + j * 5) % 4) / 64.0::DOUBLE AS lon
    FROM nation, (VALUES {", ".join(f"({j}, {x}, {y})" for j, (x, y) in enumerate(_CORNERS))}) c(j, dx, dy)),
  edge AS (SELECT a.country, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM star a JOIN star b ON a.country = b.country AND b.j = (a.j + 1) % {len(_CORNERS)})"""


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    corners = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for j, (x, y) in enumerate(_CORNERS)))
    rows = table(spark, sf_dir, "nation").select(k, F.inline(corners))
    length = 4 + (k * 7 + F.col("j") * 5) % 4
    return rows.select(k.alias("country"), F.lit(0).alias("ring"), F.col("j").alias("ord"), (44.0 + (k % 5) * 1.1 + F.col("dy") * length / 64.0).alias("lat"), (12.0 + F.floor(k / 5) * 1.3 + F.col("dx") * length / 64.0).alias("lon"))


def _inside(points: str, *key: str) -> str:
    """Ray casting of all points against all edges."""
    names = ", ".join(key)
    return f"""(SELECT {names}, min(country) AS country FROM (SELECT {names}, country FROM {points}, edge WHERE ((blon > lon) <> (alon > lon)) AND lat < (alat - blat) * (lon - blon) / (alon - blon) + blat GROUP BY {names}, country HAVING count(*) % 2 = 1) GROUP BY {names})"""


@query(f"""WITH {_STARS}, p AS (SELECT o_orderkey AS id, 43.5::DOUBLE + (o_orderkey % 613) * 0.01::DOUBLE AS lat, 11.5::DOUBLE + (o_custkey * 7 % 751) * 0.01::DOUBLE AS lon FROM orders)
  SELECT id, country FROM p LEFT JOIN {_inside("p", "id")} USING (id)""")
def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country of every order's place."""
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (43.5 + (F.col("o_orderkey") % 613) * 0.01).alias("lat"), (11.5 + (F.col("o_custkey") * 7 % 751) * 0.01).alias("lon"))
    return places.look_up(points, places.cells(_stars(spark, sf_dir)), "id")


_CUT = f"""{_LEGS}, {_STARS}, place AS (SELECT route_id, sample, d, unnest([0, 1, 2]) AS w, [sample * 10.0::DOUBLE, sample * 10.0::DOUBLE + d / 2, sample * 10.0::DOUBLE + d] AS at3 FROM sm),
  there AS (SELECT route_id, sample, w, at3[w + 1] AS at_km, d FROM place),
  hits AS (SELECT t.*, lat1, lon1, lat2, lon2, end_km - km AS s, km, row_number() OVER (PARTITION BY t.route_id, sample, w ORDER BY seg) AS k FROM there t JOIN legs ON t.route_id = legs.route_id AND at_km >= end_km - km - 1e-9 AND at_km <= end_km + 1e-9),
  loc AS (SELECT route_id, sample, w, d, lat1 + (lat2 - lat1) * (at_km - s) / km AS lat, lon1 + (lon2 - lon1) * (at_km - s) / km AS lon FROM hits WHERE k = 1),
  m AS (SELECT * FROM loc WHERE w = 1), c AS (SELECT route_id, sample, country FROM {_inside("m", "route_id", "sample")}),
  cut AS (SELECT m.route_id, m.sample, m.d, country, a.lat AS la, a.lon AS oa, b.lat AS lb, b.lon AS ob FROM m JOIN loc a ON a.route_id = m.route_id AND a.sample = m.sample AND a.w = 0 JOIN loc b ON b.route_id = m.route_id AND b.sample = m.sample AND b.w = 2 LEFT JOIN c ON c.route_id = m.route_id AND c.sample = m.sample)"""


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("ord"), F.col("route_id")
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("ord"))
    points = points.select("route_id", "ord", (45.5 + (k % 10) * 0.1 + i * 0.07).alias("lat"), (13.0 + i * 0.45 + (k % 7) * 0.02).alias("lon"))
    return places.classified(places.stretches(geo.segments(points), STEP_KM), places.cells(_stars(spark, sf_dir)))


@query(f"WITH {_CUT} SELECT route_id, coalesce(country, -1) AS country, count(*) AS samples, floor(sum(d) * 1000 + 0.5) / 1000 AS km FROM cut GROUP BY 1, 2")
def country_kilometres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilometres of every route by country; -1 is none."""
    return _cut(spark, sf_dir).groupBy("route_id", F.coalesce("country", F.lit(-1)).alias("country")).agg(F.count("*").alias("samples"), round_up(F.sum("distance_km"), 3).alias("km"))


def _thousandths(lat: Column, lon: Column) -> Column:
    return F.concat_ws(" ", *(F.floor(x * 1000 + 0.5).cast("bigint").cast("string") for x in (lat, lon)))


@query(f"""WITH {_CUT}, kd AS (SELECT cut.*, CASE WHEN country = n_nationkey THEN 'domestic' ELSE 'foreign' END AS kind FROM cut JOIN supplier ON route_id = s_suppkey JOIN nation ON n_nationkey = s_nationkey % 5 + 5),
  ch AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY route_id ORDER BY sample) THEN 0 ELSE 1 END AS x FROM kd), i AS (SELECT *, sum(x) OVER (PARTITION BY route_id ORDER BY sample ROWS UNBOUNDED PRECEDING) AS island FROM ch)
  SELECT route_id, CAST(island AS BIGINT) AS island, kind, count(*) AS samples, floor(sum(d) * 1000 + 0.5) / 1000 AS km,
    arg_min(CAST(CAST(floor(la * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(floor(oa * 1000 + 0.5) AS BIGINT) AS VARCHAR), sample) || ',' || string_agg(CAST(CAST(floor(lb * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(floor(ob * 1000 + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY sample) AS line
  FROM i GROUP BY 1, 2, 3""")
def route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domestic and foreign runs of every route with their lines, in thousandths of a degree."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route_id"), (F.col("s_nationkey") % 5 + 5).alias("home"))
    kinds = _cut(spark, sf_dir).join(supplier, "route_id").withColumn("kind", F.when(F.col("country") == F.col("home"), "domestic").otherwise("foreign"))
    runs = places.merged_runs(kinds, "kind")
    line = F.array_join(F.transform("line", lambda p: _thousandths(p["lat"], p["lon"])), ",")
    return runs.select("route_id", "island", "kind", "samples", round_up(F.col("distance_km"), 3).alias("km"), line.alias("line"))
