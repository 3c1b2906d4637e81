"""Distances, polygons and ordered route points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Mean Earth radii that freight and route-cost figures are made with.  Fixed values.
FREIGHT_RADIUS, ROUTE_RADIUS = 6371.0, 6371.0088
#: (latitude, longitude) of a simplified border of Slovenia.  Fixed values.
SLOVENIA = [
    (46.878, 13.714), (46.875, 14.550), (46.867, 15.650), (46.831, 16.321), (46.655, 16.576), (46.476, 16.454), (46.348, 16.297), (46.229, 16.174), (46.083, 15.981),
    (45.914, 15.775), (45.825, 15.672), (45.733, 15.580), (45.642, 15.348), (45.592, 15.132), (45.477, 14.972), (45.452, 14.642), (45.422, 14.274), (45.467, 13.941),
    (45.590, 13.616), (45.745, 13.577), (45.978, 13.607), (46.226, 13.490), (46.432, 13.604), (46.536, 13.714), (46.878, 13.714),
]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Kilometres along a great circle."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * radius * F.asin(F.sqrt(a))


def in_polygon(lat: Column, lon: Column, polygon: list[tuple[float, float]] = SLOVENIA) -> Column:
    """Ray casting: whether an odd number of edges lies beyond the point."""
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip([polygon[-1], *polygon[:-1]], polygon, strict=True):
        if a_lon != b_lon:
            meets = (F.lit(b_lon) > lon) != (F.lit(a_lon) > lon)
            crossings = crossings + F.when(meets & (lat < (a_lat - b_lat) * (lon - b_lon) / (a_lon - b_lon) + b_lat), 1).otherwise(0)
    return crossings % 2 == 1


def segments(points: DataFrame, route: str = "route_id", order: str = "ord", lat: str = "lat", lon: str = "lon", radius: float = ROUTE_RADIUS) -> DataFrame:
    """route, seg, start_km, end_km and both ends of each leg; legs of no length go, kilometres run on."""
    by = Window.partitionBy(route).orderBy(order)
    legs = points.select(route, F.col(order).alias("seg"), F.col(lat).alias("lat1"), F.col(lon).alias("lon1"), F.lead(lat).over(by).alias("lat2"), F.lead(lon).over(by).alias("lon2")).where("lat2 IS NOT NULL")
    legs = legs.withColumn("km", haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), radius)).where("km > 0")
    end = F.sum("km").over(Window.partitionBy(route).orderBy("seg").rowsBetween(Window.unboundedPreceding, 0))
    return legs.withColumn("end_km", end).withColumn("start_km", F.col("end_km") - F.col("km"))


def resample(legs: DataFrame, step_km: float, route: str = "route_id") -> DataFrame:
    """route, sample, distance_km and midpoint of the stretches of ``step_km`` that a route falls into."""
    totals = legs.groupBy(route).agg(F.max("end_km").alias("total_km"))
    last = F.greatest(F.ceil(F.col("total_km") / step_km) - 1, F.lit(0)).cast("int")
    # the stretches whose middle may lie on a leg, leg by leg
    low, high = F.greatest(F.floor(F.col("start_km") / step_km) - 1, F.lit(0)).cast("int"), F.least(last, (F.floor(F.col("end_km") / step_km)).cast("int"))
    samples = legs.join(totals, route).withColumn("sample", F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high)))))
    samples = samples.withColumn("distance_km", F.least(F.lit(step_km), F.col("total_km") - F.col("sample") * step_km)).withColumn("at_km", F.col("sample") * step_km + F.col("distance_km") / 2)
    hits = samples.where("at_km >= start_km AND at_km <= end_km")
    first = hits.groupBy(route, "sample").agg(F.min(F.struct("seg", "distance_km", "at_km", "start_km", "end_km", "lat1", "lon1", "lat2", "lon2")).alias("h")).select(route, "sample", "h.*")
    ratio = (F.col("at_km") - F.col("start_km")) / (F.col("end_km") - F.col("start_km"))
    return first.select(route, "sample", "distance_km", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * ratio).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * ratio).alias("lon"))


def islands(rows: DataFrame, kind: str, route: str = "route_id", order: str = "sample") -> DataFrame:
    """Adds island: the number of the run of equal ``kind`` that a row is in, from 1."""
    by = Window.partitionBy(route).orderBy(order)
    changed = F.when(F.col(kind) == F.lag(kind).over(by), 0).otherwise(1)
    return rows.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def loading_meters(floor_area_m2: Column) -> Column:
    """Floor area over the 2.4 m that a trailer is wide."""
    return floor_area_m2 / 2.4


def utilisation(loading: Column) -> Column:
    """Share of a trailer of 13.6 loading metres."""
    return loading / 13.6
