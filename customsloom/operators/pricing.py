"""Freight, landed cost and route-cost prices as expressions, and the nearest historical price by a search in cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from customsloom.functions.numbers import round_even, round_money, round_up
from customsloom.functions.tariff import of_map

#: Diesel by country, the default and base price, the base rate per km and the least rate.  Fixed values.
FUEL = {"SI": 1.70, "DE": 1.98, "AT": 1.82, "IT": 1.89, "HR": 1.65}
DEFAULT_FUEL, BASE_DIESEL, BASE_RATE, LEAST_RATE = 1.75, 1.55, 1.35, 1.7
#: Vehicles: base price and price per kg.  Fixed values.
VEHICLES = {"VAN": (85.0, 0.18), "TRUCK_7_5T": (145.0, 0.12), "TRUCK_13_6M": (260.0, 0.08), "MEGA_TRAILER": (310.0, 0.075)}
#: Sample duty rates by heading, and the default.  Fixed values.
DUTIES, DEFAULT_DUTY = {"6109": 12.0, "6403": 8.0, "9403": 2.7, "8543": 3.7, "2204": 13.1}, 4.2


def corridor_fuel(origin: Column, destination: Column) -> Column:
    """Mean of the two countries' diesel."""
    return (F.coalesce(of_map(origin, FUEL), F.lit(DEFAULT_FUEL)) + F.coalesce(of_map(destination, FUEL), F.lit(DEFAULT_FUEL))) / 2


def full_load(distance: Column, fuel: Column, pallets: Column, weight_kg: Column, loading: Column) -> Column:
    """Rate by fuel, at least 1.7 a km, times a load factor; between 1.6 and 2.4 a km."""
    rate = F.greatest(F.lit(BASE_RATE) * fuel / BASE_DIESEL, F.lit(LEAST_RATE))
    price = distance * rate * (1.0 + pallets * 0.05 + weight_kg / 1000 * 0.03 + loading * 0.06)
    return F.least(F.greatest(price, distance * 1.6), distance * 2.4)


def part_load(distance: Column, weight_kg: Column, pallets: Column, loading: Column) -> Column:
    return distance * 0.18 + weight_kg * 0.02 + pallets * 10 + loading * 8


def blended(distance: Column, similar: Column, model: Column, fallback: Column, pallets: Column, weight_kg: Column, loading: Column) -> Column:
    """Under 180 km similar, model and fallback price by 6:3:1, raised by load, between 60 and 180; else similar and fallback by 6:4.

    A missing model price is the fallback, a missing similar one the model price.
    """
    model = F.coalesce(model, fallback)
    similar = F.coalesce(similar, model)
    near = (0.6 * similar + 0.3 * model + 0.1 * fallback) * (1 + pallets * 0.04 + weight_kg / 1000 * 0.03 + loading * 0.05)
    return F.when(distance < 180, F.least(F.greatest(near, F.lit(60.0)), F.lit(180.0))).otherwise(0.6 * similar + 0.4 * fallback)


def markup(cost: Column, low: float = 0.20, middle: float = 0.10, high: float = 0.05) -> Column:
    """20 % under 200, 10 % up to 500, 5 % above."""
    return cost * (1 + F.when(cost < 200, low).when(cost <= 500, middle).otherwise(high))


FEATURES = ["distance_km", "weight_kg", "pallets", "loading_meters"]
#: What a unit of each feature adds to a score.  Fixed values.
UNITS = [1.0, 0.01, 10.0, 10.0]
#: Pairs of requests and past trips below which all are compared.
PAIRS = 1 << 23


def _score() -> Column:
    return round_up(sum((F.abs(F.col(f"h{i}") - F.col(f)) * u for i, (f, u) in enumerate(zip(FEATURES, UNITS, strict=True))), F.lit(0.0)), 6)


def nearest_price(requests: DataFrame, history: DataFrame, pairs: int | None = None) -> DataFrame:
    """For each request (request_id, distance_km, weight_kg, pallets, loading_meters) the price of the most alike trip of 0.5 to 1.5 times its distance.

    The score is a sum of differences, so a trip that differs by more than ``side`` in one feature can't be better than one of a
    lesser score.  Requests and past trips lie in cells of that side over the four features; the fewer of both are dealt to the 81 cells around
    theirs, and of what scores less than the side, which few pairs do, the best is the best of all.  The rest goes on with cells of twice the side, and when few pairs
    are left (``pairs``; by default PAIRS, or eight requests), all within bands of the distance.  The first side follows from the trips' number and spread, so that a request meets
    about as many trips at any size.  Ties go to the smaller transport_id; requests and trips with a null feature have no part.
    """
    past = history.dropna(subset=[*FEATURES, "price"]).select("transport_id", *(F.col(f).cast("double").alias(f"h{i}") for i, f in enumerate(FEATURES)), "price")
    asked = requests.select("request_id", *(F.col(f).cast("double").alias(f) for f in FEATURES)).dropna(subset=FEATURES)
    spread = past.agg(F.count("*").alias("n"), *(F.coalesce(F.max(f"h{i}") - F.min(f"h{i}"), F.lit(0.0)).alias(f"r{i}") for i in range(4))).first()
    n, todo, found = spread["n"], asked.select(*FEATURES).distinct().persist(), []
    pairs = max(PAIRS, 8 * n) if pairs is None else pairs
    side = 1.3 * (1.5 * math.prod(max(1.0, spread[f"r{i}"] * u) for i, u in enumerate(UNITS)) / max(1, n)) ** 0.25
    session = requests.sparkSession
    tasks = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    within = (F.col("h0") >= F.col(FEATURES[0]) * 0.5) & (F.col("h0") <= F.col(FEATURES[0]) * 1.5)
    price = F.struct(_score().alias("score"), "transport_id", "price")
    while (left := todo.count()) * n > pairs:
        own, trips = FEATURES, [f"h{i}" for i in range(4)]
        asking, held = (_around(todo, own, side), _in_cells(past, trips, side)) if left <= n else (_in_cells(todo, own, side), _around(past, trips, side))
        asking, held = asking.repartition(tasks, "_cell"), held.repartition(tasks, "_cell")  # few bytes, much work
        close = asking.join(held.hint("merge"), "_cell").where(within & (_score() < side - 1e-5))
        sure = close.groupBy(*FEATURES).agg(F.min(price).alias("b")).persist()
        found.append(sure)
        todo, side = todo.join(sure.select(*FEATURES).hint("merge"), FEATURES, "left_anti").persist(), side * 2
        if side > 4 * max(spread[f"r{i}"] * u for i, u in enumerate(UNITS)):
            break
    found.append(_nearest_in_bands(todo, past, within, price))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return asked.join(out.hint("merge"), FEATURES).select("request_id", "b.transport_id", "b.score", F.col("b.price").alias("similar_price"))


def _cell(x: str, unit: float, side: float) -> Column:
    return F.floor(F.col(x) * (unit / side)).cast("bigint")


def _in_cells(rows: DataFrame, features: list[str], side: float) -> DataFrame:
    """With the hash of each row's cell; two cells of one hash are compared in vain, no more."""
    return rows.withColumn("_cell", F.xxhash64(*(_cell(x, u, side) for x, u in zip(features, UNITS, strict=True))))


def _around(rows: DataFrame, features: list[str], side: float) -> DataFrame:
    """Each row with its cell and the 80 around it."""
    for i, (x, u) in enumerate(zip(features, UNITS, strict=True)):
        at = _cell(x, u, side)
        rows = rows.withColumn(f"_c{i}", F.explode(F.array(at - 1, at, at + 1)))
    at = [f"_c{i}" for i in range(len(features))]
    return rows.withColumn("_cell", F.xxhash64(*at)).drop(*at)


def _nearest_in_bands(asked: DataFrame, past: DataFrame, within: Column, price: Column) -> DataFrame:
    """All pairs in range: both sides are cut into logarithmic bands of the distance, at most four a request."""
    band = lambda x: F.floor(F.ln(F.greatest(x, F.lit(0.001))) / math.log(1.5)).cast("int")
    distance = F.col(FEATURES[0])
    around = asked.withColumn("band", F.explode(F.sequence(band(distance * 0.5), band(distance * 1.5))))
    return around.join(past.withColumn("band", band(F.col("h0"))), "band").where(within).groupBy(*FEATURES).agg(F.min(price).alias("b"))


def transport_estimate(vehicle: Column, weight_kg: Column, loading: Column, pickup: Column, delivery: Column) -> Column:
    """Base, weight and loading metres times a factor of the distance between postal codes."""
    first = lambda c: F.substring(F.regexp_replace(c, r"\D", ""), 1, 2).try_cast("int")
    spread = F.abs(first(pickup) - first(delivery))
    factor = F.when(spread.isNull(), 1.25).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(3.8), 1 + spread / 18)))
    base, rate = of_map(vehicle, {k: v[0] for k, v in VEHICLES.items()}), of_map(vehicle, {k: v[1] for k, v in VEHICLES.items()})
    return round_money((base + weight_kg * rate + F.greatest(loading, F.lit(0.0)) * 95) * factor)


def duty_rate(code: Column, route: Column) -> Column:
    return F.when(route == "INTRA_EU", 0.0).otherwise(F.coalesce(of_map(F.substring(code, 1, 4), DUTIES), F.lit(DEFAULT_DUTY)))


def landed_cost(goods: Column, transport: Column, duty_percent: Column, vat_percent: Column, import_vat: Column) -> dict[str, Column]:
    """Duty, customs value, VAT, charges and total, each rounded before the next."""
    duty = round_money(goods * duty_percent / 100)
    value = round_money(goods + transport + duty)
    vat = F.when(import_vat & vat_percent.isNotNull(), round_money(value * vat_percent / 100)).otherwise(0.0)
    return {"duty_amount": duty, "customs_value": value, "vat_amount": vat, "import_charges": round_money(duty + vat), "landed_cost": round_money(value + vat)}


def cost_split(total_km: Column, domestic_km: Column, cost: Column) -> dict[str, Column]:
    """Domestic and foreign kilometres, percent and whole costs; the foreign cost is what is left of the rounded total."""
    home = F.least(domestic_km, total_km)
    percent = F.when(total_km > 0, home / total_km * 100).otherwise(0.0)
    whole = round_even(cost)
    domestic = F.when(total_km > 0, round_even(home / total_km * cost)).otherwise(0.0)
    return {"total_km": round_up(total_km, 2), "domestic_km": round_up(home, 2), "foreign_km": round_up(F.greatest(total_km - home, F.lit(0.0)), 2), "domestic_percent": round_up(percent, 1), "domestic_cost": domestic, "foreign_cost": whole - domestic}
