"""Packing texts written from orders, in six layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.functions.numbers import round_up
from customsloom.operators import shipment
from customsloom.plans.bindings import table
from customsloom.plans.registry import query

#: Layouts: {g} and {n} are weights, {c} packages, {p} pallets, {a} x {b} x 145 a pallet.
LAYOUTS = [
    "Packing: {c} CARTONS ({p} PALLETE)\nGross weight: {g} kg   Net weight: {n} kg\nPallet dimensions: {a}x{b}x145 cm",
    "Bruto / Gross = {g} kg\nNeto / Nett: {n} kg\nŠtevilo koli: {c}\n{p} palete\nPaleta dimenzije {a} x {b} x 145 cm",
    "Item     Gross      Net\nTotal    {g}  {n}\n{c} colli on {p} pallets, dimensions {a}×{b}×145",
    "Btto {g} lb Ntto {n} lb\nNumber of packages: {c}\nPallets: {p}\nAbmessungen {a}0 x {b}0 x 1450 mm",
    "Total of the invoice 12.345,00 EUR, 3 pages\nPoids brut: kg {g}; poids net: kg {n}; {c} ctns\n{p} x pallets 0.{a} x 0.{b} x 1.45 m dimension 0.{a} x 0.{b} x 1.45 m",
    "Tara 62\nPeso bruto {g} g\nPeso neto {n} g\nBoxes {c}\nPallet(s) {p}\nMaße: {a} x {b} x 145 cm",
]
_UNITS = [1.0, 1.0, 1.0, 0.45359237, 1.0, 0.001]
_TYPES = ["CT", "COLLI", "COLLI", "COLLI", "CT", "CT"]


@query(f"""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderkey % 6 AS INTEGER) AS k, (o_orderkey % 900 + 100) AS w, o_custkey % 90 + 1 AS c, o_custkey % 7 + 1 AS p, o_orderkey % 60 + 40 AS a, o_custkey % 50 + 40 AS b FROM orders)
  SELECT id, floor((w + 0.5::DOUBLE) * {_UNITS}[k + 1]::DOUBLE * 1000000 + 0.5) / 1000000 AS gross_kg, floor((w - 50 + 0.25::DOUBLE) * {_UNITS}[k + 1]::DOUBLE * 1000000 + 0.5) / 1000000 AS net_kg, CASE WHEN k = 5 THEN 62.0 END AS tare_kg, c AS packages, {_TYPES}[k + 1] AS package_type, p AS pallets,
    a || 'x' || b || 'x145 cm' AS dimensions FROM o""")
def shipment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, packages, pallets and dimensions of every order's packing text."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    w = k % 900 + 100
    shown = {"g": F.format_string("%d.50", w), "n": F.format_string("%d.25", w - 50), "c": (u % 90 + 1).cast("string"), "p": (u % 7 + 1).cast("string"), "a": (k % 60 + 40).cast("string"), "b": (u % 50 + 40).cast("string")}
    text = F.element_at(F.array(*(F.lit(x) for x in LAYOUTS)), (k % 6 + 1).cast("int"))
    for name, value in shown.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    found = shipment.summaries(table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("text")))
    return found.withColumns({c: round_up(F.col(c), 6) for c in ("gross_kg", "net_kg")})
