"""Points to countries by a quadtree of cells, and routes by country: kilometres and merged runs with their lines.

Polygons are cut into cells of a quadtree.  A cell that no border passes lies wholly in a country or out of it; where a border
passes, the cell is cut in four, down to ``depth``.  The smallest cells hold the edges that a ray from one of their points can
meet.  A point is looked up by its cells' numbers, one a level, with an equi-join; edges are looked at in border cells only.  The
work on polygons grows with the length of their borders, not with their area or with the number of points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.geo import islands
from customsloom.sources.shared import stored

#: Levels of the quadtree; at 10 a cell is 0.35 degrees wide and 0.18 high.
DEPTH = 10
_NEAR = 1e-12


def edges(rings: DataFrame) -> DataFrame:
    """(country, x1, y1, x2, y2) of the closed rings (country, ring, ord, lat, lon): x from 0 to 1 by longitude, y by latitude.

    A country may have several rings: parts, and holes in them.  Rows without a coordinate are left out."""
    rows = rings.where("country IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    by = Window.partitionBy("country", "ring").orderBy("ord")
    ends = Window.partitionBy("country", "ring").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here, after = F.struct("lon", "lat"), F.coalesce(F.lead(F.struct("lon", "lat")).over(by), F.first(F.struct("lon", "lat")).over(ends))
    rows = rows.select("country", here.alias("a"), after.alias("b"))
    return rows.select("country", F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"))


def _size(level: int) -> tuple[float, float]:
    return 360.0 / 2**level, 180.0 / 2**level


def _cell(lat: Column, lon: Column, level: Column | int) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    top = n.cast("int") - 1
    return F.least(F.floor((lon + 180.0) / 360.0 * n).cast("int"), top), F.least(F.floor((lat + 90.0) / 180.0 * n).cast("int"), top)


def _touches(level: int) -> Column:
    """Whether an edge meets its row's cell (or comes as near as rounding)."""
    w, h = _size(level)
    left, low = F.col("ix") * w - 180.0, F.col("iy") * h - 90.0
    right, high = left + w, low + h
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    boxes = (F.greatest(x1, x2) >= left - _NEAR) & (F.least(x1, x2) <= right + _NEAR) & (F.greatest(y1, y2) >= low - _NEAR) & (F.least(y1, y2) <= high + _NEAR)
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (left, right) for y in (low, high)]
    return boxes & (F.greatest(*sides) >= -_NEAR) & (F.least(*sides) <= _NEAR)


def _beyond(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray upwards from a point meets an edge."""
    meets = (e["x2"] > x) != (e["x1"] > x)
    return meets & (y < (e["y1"] - e["y2"]) * (x - e["x2"]) / F.when(e["x1"] == e["x2"], 1.0).otherwise(e["x1"] - e["x2"]) + e["y2"])


def _columns_of(border: DataFrame, level: int) -> DataFrame:
    """(country, ix, x1..y2): each edge in every column of cells that it passes."""
    w, last = _size(level)[0], 2**level - 1
    number = lambda x: F.greatest(F.lit(0), F.least(F.lit(last), F.floor((x + 180.0) / w).cast("int")))
    return border.withColumn("ix", F.explode(F.sequence(number(F.least("x1", "x2") - _NEAR), number(F.greatest("x1", "x2") + _NEAR))))


def cells(rings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(level, ix, iy, country, edges): cells wholly inside a country (no edges), and the smallest border cells with the edges above them."""
    border = stored(edges(rings), "edges")
    met = border.withColumns({"ix": F.lit(0), "iy": F.lit(0)})
    inside = []
    key = ["country", "ix", "iy"]
    for level in range(1, depth + 1):
        quarter = F.explode(F.array(*(F.struct((F.col("ix") * 2 + i).alias("ix"), (F.col("iy") * 2 + j).alias("iy")) for i in (0, 1) for j in (0, 1))))
        children = met.select(*key).distinct().select("country", quarter.alias("c")).select("country", "c.ix", "c.iy")
        met = met.select("country", "x1", "y1", "x2", "y2", quarter.alias("c")).select("country", "x1", "y1", "x2", "y2", "c.ix", "c.iy").where(_touches(level))
        met = stored(met, "quadtree")  # each level comes from the one before, and is read twice
        w, h = _size(level)
        free = children.join(met.select(*key).distinct(), key, "left_anti").withColumns({"x": (F.col("ix") + 0.5) * w - 180.0, "y": (F.col("iy") + 0.5) * h - 90.0})
        crossed = free.join(_columns_of(border, level), ["country", "ix"]).where(_beyond(F.col("x"), F.col("y"), F.struct("x1", "y1", "x2", "y2")))
        inside.append(crossed.groupBy(*key).agg(F.count("*").alias("n")).where("n % 2 = 1").select(F.lit(level).alias("level"), "ix", "iy", "country"))
    h = _size(depth)[1]
    above = met.select(*key).distinct().join(_columns_of(border, depth), ["country", "ix"]).where(F.greatest("y1", "y2") >= F.col("iy") * h - 90.0)
    leaves = above.groupBy(*key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")).select(F.lit(depth).alias("level"), "ix", "iy", "country", "edges")
    return reduce(DataFrame.unionByName, inside).withColumn("edges", F.lit(None).cast(leaves.schema["edges"].dataType)).unionByName(leaves)


def look_up(points: DataFrame, of: DataFrame, *key: str, depth: int = DEPTH) -> DataFrame:
    """The key columns of every point (key, lat, lon) and its country: the least one where countries overlap, null where there is none.

    Points without a coordinate, or outside 90 and 180 degrees, are nowhere.  Points of one key are one point."""
    on_earth = (F.abs(F.col("lat")) <= 90) & (F.abs(F.col("lon")) <= 180)
    rows = points.select(*key, F.col("lat"), F.col("lon"), F.explode_outer(F.when(on_earth, F.sequence(F.lit(1), F.lit(depth)))).alias("level"))
    ix, iy = _cell(F.col("lat"), F.col("lon"), F.col("level"))
    rows = rows.withColumns({"ix": ix, "iy": iy})
    found = rows.join(of, ["level", "ix", "iy"], "left")
    odd = F.size(F.filter("edges", lambda e: _beyond(F.col("lon"), F.col("lat"), e))) % 2 == 1
    hit = F.when(F.col("edges").isNull() | odd, F.col("country"))
    return found.groupBy(*key).agg(F.min(hit).alias("country"))


def points_at(legs: DataFrame, places: DataFrame, step_km: float) -> DataFrame:
    """The places (route_id, n, at_km) with lat and lon on the route's legs; a place between two legs is the first one's end.

    Legs and places meet in stretches of ``step_km`` of their route, so that a long route's legs aren't compared with all its places."""
    stretch = lambda x: F.floor(F.col(x) / step_km)
    cut = legs.withColumn("stretch", F.explode(F.sequence(stretch("start_km"), stretch("end_km"))))
    hits = places.withColumn("stretch", stretch("at_km")).join(cut, ["route_id", "stretch"]).where("at_km >= start_km AND at_km <= end_km")
    first = hits.groupBy("route_id", "n", "at_km").agg(F.min(F.struct("seg", "start_km", "end_km", "lat1", "lon1", "lat2", "lon2")).alias("h")).select("route_id", "n", "at_km", "h.*")
    ratio = (F.col("at_km") - F.col("start_km")) / (F.col("end_km") - F.col("start_km"))
    return first.select("route_id", "n", "at_km", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * ratio).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * ratio).alias("lon"))


def stretches(legs: DataFrame, step_km: float) -> DataFrame:
    """(route_id, sample, distance_km, start, middle, end): a route cut each ``step_km``, with the places (lat, lon) of its cuts."""
    totals = legs.groupBy("route_id").agg(F.max("end_km").alias("total"))
    n = F.greatest(F.ceil(F.col("total") / step_km).cast("int"), F.lit(1))
    each = totals.withColumn("sample", F.explode(F.sequence(F.lit(0), n - 1)))
    begin, end = F.col("sample") * step_km, F.least((F.col("sample") + 1) * step_km, F.col("total"))
    places = each.select("route_id", F.explode(F.array(*(F.struct((F.col("sample") * 3 + i).alias("n"), at.alias("at_km")) for i, at in enumerate((begin, (begin + end) / 2, end))))).alias("p")).select("route_id", "p.*")
    found = points_at(legs, places, step_km).withColumns({"sample": F.floor(F.col("n") / 3).cast("int"), "which": F.col("n") % 3})
    of = lambda i: F.max(F.when(F.col("which") == i, F.struct("lat", "lon")))
    out = found.groupBy("route_id", "sample").agg(of(0).alias("start"), of(1).alias("middle"), of(2).alias("end"), (F.max("at_km") - F.min("at_km")).alias("distance_km"))
    return out.select("route_id", "sample", "distance_km", "start", "middle", "end")


def classified(cut: DataFrame, of: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds the country of each stretch's middle."""
    middles = cut.select("route_id", "sample", F.col("middle.lat").alias("lat"), F.col("middle.lon").alias("lon"))
    return cut.join(look_up(middles, of, "route_id", "sample", depth=depth), ["route_id", "sample"])


def merged_runs(cut: DataFrame, kind: str) -> DataFrame:
    """(route_id, island, kind, samples, distance_km, line): runs of stretches of equal ``kind``, each with its line: the first start, then every end."""
    runs = islands(cut, kind)
    each = F.array_sort(F.collect_list(F.struct("sample", "start", "end")))
    out = runs.groupBy("route_id", "island", kind).agg(F.count("*").alias("samples"), F.sum("distance_km").alias("distance_km"), each.alias("parts"))
    line = F.concat(F.array(F.col("parts")[0]["start"]), F.transform("parts", lambda p: p["end"]))
    return out.select("route_id", "island", kind, "samples", "distance_km", line.alias("line"))
