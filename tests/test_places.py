from __future__ import annotations

import random

from customsloom.functions import geo
from customsloom.operators import places


def inside(rings, lat, lon):
    n = 0
    for ring in rings:
        for (a_lat, a_lon), (b_lat, b_lon) in zip([ring[-1], *ring[:-1]], ring, strict=True):
            if (b_lon > lon) != (a_lon > lon) and lat < (a_lat - b_lat) * (lon - b_lon) / (a_lon - b_lon) + b_lat:
                n += 1
    return n % 2 == 1


def test_same_as_ray_casting_over_all_polygons(spark):
    rng = random.Random(4)
    countries = {
        "SI": [geo.SLOVENIA[:-1]],
        "world": [[(-90, -180), (-90, 180), (90, 180), (90, -180)]],  # every point, with its edges at the limits of the earth
        "lake": [[(45, 13), (45, 17), (47, 17), (47, 13)], [(45.5, 14), (45.5, 15), (46.5, 15), (46.5, 14)], [(45.9, 14.4), (45.9, 14.6), (46.1, 14.6), (46.1, 14.4)]],  # a hole, and land in it
        "zigzag": [[(44 + (i % 2) * 3, 12 + i * 0.11) for i in range(30)] + [(43, 15)]],
        "line": [[(10, 10), (10, 11)]], "south": [[(-30.0, -70.0), (-31.5, -69.2), (-33.1, -71.4)]],
    }
    rows = [(c, i, j, float(lat), float(lon)) for c, rings in countries.items() for i, ring in enumerate(rings) for j, (lat, lon) in enumerate(ring)] + [(None, 0, 0, 1.0, 1.0), ("SI", 0, 99, None, 3.0)]
    points = [(i, rng.uniform(43, 48), rng.uniform(11.5, 17.5)) for i in range(1500)] + [(2000 + i, rng.uniform(-34, -29), rng.uniform(-72, -68)) for i in range(200)]
    points += [(3000, None, 14.0), (3001, 95.0, 14.0), (3002, 46.0, 14.5), (3003, 0.0, 180.0), (3004, -89.99, -180.0)]
    for depth in (1, 5, 9):
        of = places.cells(spark.createDataFrame(rows, "country string, ring int, ord int, lat double, lon double"), depth)
        got = {r["id"]: r["country"] for r in places.look_up(spark.createDataFrame(points, "id int, lat double, lon double"), of, "id", depth=depth).collect()}
        for i, lat, lon in points:
            here = sorted(c for c, rings in countries.items() if lat is not None and abs(lat) <= 90 and inside(rings, lat, lon))
            assert got[i] == (here[0] if here else None), (i, lat, lon)
    assert of.where("edges IS NULL").count() > 100  # cells that need no edges


def test_runs_have_the_lines_of_their_stretches(spark):
    points = spark.createDataFrame([(1, i, 46.0, 14.0 + 0.5 * i) for i in range(5)] + [(2, 0, 45.0, 10.0), (2, 1, 45.0, 10.01), (3, 0, 1.0, 1.0), (3, 1, 1.0, 1.0)], "route_id int, ord int, lat double, lon double")
    cut = places.stretches(geo.segments(points), 10.0)
    total = {r["route_id"]: r["km"] for r in geo.segments(points).groupBy("route_id").agg({"km": "sum"}).toDF("route_id", "km").collect()}
    rows = cut.orderBy("route_id", "sample").collect()
    for route, km in total.items():
        mine = [r for r in rows if r["route_id"] == route]
        assert abs(sum(r["distance_km"] for r in mine) - km) < 1e-6 and len(mine) == int(-(-km // 10))
        for a, b in zip(mine, mine[1:], strict=False):
            assert abs(a["end"]["lon"] - b["start"]["lon"]) < 1e-9
    assert set(total) == {1, 2}  # a route that doesn't move has no stretch
    kinds = cut.selectExpr("*", "IF(sample BETWEEN 4 AND 6 OR sample = 9, 'a', 'b') AS kind")
    runs = sorted((r["route_id"], r["island"], r["kind"], r["samples"], len(r["line"])) for r in places.merged_runs(kinds, "kind").collect())
    n = sum(r["route_id"] == 1 for r in rows)
    assert runs == [(1, 1, "b", 4, 5), (1, 2, "a", 3, 4), (1, 3, "b", 2, 3), (1, 4, "a", 1, 2), (1, 5, "b", n - 10, n - 9), (2, 1, "b", 1, 2)]
