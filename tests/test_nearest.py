from __future__ import annotations

import random

from customsloom.operators import pricing

FIELDS = "distance_km double, weight_kg double, pallets double, loading_meters double"


def _rows(n, seed):
    r = random.Random(seed)
    return [(i, float(r.randint(5, 300)), float(r.randint(0, 3000)), float(r.randint(0, 9)), r.randint(0, 90) / 10) for i in range(n)]


def test_whichever_side_is_dealt_around_and_no_side_is_broadcast(spark):
    for few, many in ((40, 400), (400, 40)):
        asked, past = _rows(few, 1), [(*x, float(x[0])) for x in _rows(many, 2)]
        got = pricing.nearest_price(spark.createDataFrame(asked, f"request_id int, {FIELDS}"), spark.createDataFrame(past, f"transport_id int, {FIELDS}, price double"), pairs=100)
        score = lambda a, b: round(abs(a[1] - b[1]) + abs(a[2] - b[2]) / 100 + abs(a[3] - b[3]) * 10 + abs(a[4] - b[4]) * 10, 6)
        want = {a[0]: min((score(a, b), b[0]) for b in past if 0.5 * a[1] <= b[1] <= 1.5 * a[1]) for a in asked if any(0.5 * a[1] <= b[1] <= 1.5 * a[1] for b in past)}
        assert {r["request_id"]: (round(r["score"], 6), r["transport_id"]) for r in got.collect()} == want
        assert "strategy=merge" in got._jdf.queryExecution().optimizedPlan().toString()
