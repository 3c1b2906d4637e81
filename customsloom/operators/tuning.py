"""Rules that raise or lower a candidate's score by what a query asks for and what the candidate is.

A rule is a line of a table; a list of rules is one fold over an array of its conditions, so that the expression grows with the
number of rules and not with what each step would repeat of the last.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from customsloom.functions.numbers import once


@dataclass(frozen=True)
class Step:
    """If the query has what is asked and the candidate is what is said, score * times + plus."""

    times: float = 1.0
    plus: float = 0.0
    any_term: tuple[str, ...] = ()
    all_terms: tuple[str, ...] = ()
    other_term: tuple[str, ...] = ()  # one of these, too
    no_term: tuple[str, ...] = ()
    family: tuple[str, ...] = ()
    no_family: tuple[str, ...] = ()
    heading: tuple[str, ...] = ()
    not_heading: tuple[str, ...] = ()
    says: tuple[str, ...] = ()  # one of these in the leaf's description
    says_all: tuple[str, ...] = ()
    says_none: tuple[str, ...] = ()
    text: tuple[str, ...] = ()  # one of these in the description with its hierarchy


#: Penalties and boosts by the query's terms.  Fixed values.
QUERY_STEPS = [
    Step(0.12, any_term=("pellet", "pellets"), heading=("9304",)),
    Step(1.35, any_term=("pellet", "pellets"), heading=("9306",)),
    Step(1.2, any_term=("pellet", "pellets"), heading=("9306",), text=("cartridge",)),
    Step(0.55, any_term=("pellet", "pellets"), no_term=("rifle",), heading=("9306",), text=("revolvers",)),
    Step(0.2, any_term=("laptop", "computer"), heading=("9612",)),
    Step(0.15, any_term=("ibuprofen", "paracetamol"), not_heading=("30",)),
    Step(0.12, any_term=("pen", "pens"), heading=("3824",)),
    Step(0.08, any_term=("marker", "permanent"), heading=("9612",)),
    Step(1.35, any_term=("marker",), heading=("9608",)),
    Step(0.05, any_term=("ups",), heading=("8543",)),
    Step(0.06, any_term=("ups", "backup"), heading=("8536",)),
    Step(1.4, any_term=("ups", "backup"), heading=("8504",)),
    Step(0.1, any_term=("proximity", "inductive"), heading=("9026",)),
    Step(1.45, any_term=("proximity", "inductive"), heading=("8536",)),
    Step(0.15, any_term=("laptop", "notebook"), heading=("8418",)),
    Step(0.05, any_term=("motor", "motors"), other_term=("electric", "electrical", "servo", "induction"), heading=("87",)),
    Step(1.45, any_term=("motor", "motors"), other_term=("electric", "electrical", "servo", "induction"), heading=("8501",)),
    Step(0.05, all_terms=("chair", "office"), heading=("9402",)),
    Step(1.4, all_terms=("chair", "office"), heading=("9401",)),
    Step(0.06, any_term=("pen",), no_term=("refill",), says=("refill",), text=("refills for",)),
    Step(1.35, any_term=("pen",), no_term=("refill",), heading=("9608",), text=("liquid ink",)),
    Step(1.4, any_term=("refill",), other_term=("pen", "ink"), heading=("9608",), says=("refill",)),
    Step(0.05, any_term=("cartridge",), other_term=("printer", "toner", "ink"), heading=("8443",)),
    Step(1.45, any_term=("cartridge",), other_term=("printer", "toner", "ink"), heading=("3215",)),
]
_V, _S, _A = 7.0, 6.5, 7.0  # points of a heading for vehicles and clothes, sensors, automation
#: Clothes by family.  Fixed values.
APPAREL_STEPS = [
    Step(plus=_V, family=("apparel_tshirt_mens",), heading=("6109",)),
    Step(0.12, family=("apparel_tshirt_mens",), heading=("6106", "6206")),
    Step(plus=_V, family=("apparel_tshirt_womens",), heading=("6109",)),
    Step(0.08, family=("apparel_tshirt_womens",), heading=("6104", "6204", "6206", "6106")),
    Step(plus=_V, family=("apparel_blouse_womens",), heading=("6206", "6106")),
    Step(0.1, family=("apparel_blouse_womens",), heading=("6105", "6205")),
    Step(plus=_V, family=("apparel_polo_mens",), heading=("6105", "6110")),
    Step(0.1, family=("apparel_polo_mens",), heading=("6205", "6206")),
    Step(plus=_V, family=("apparel_trousers_mens",), heading=("6203",)),
    Step(plus=_V * 0.6, family=("apparel_trousers_mens",), no_term=("woven",), heading=("6103",)),
    Step(0.05, family=("apparel_trousers_mens",), any_term=("woven",), heading=("6103",)),
    Step(0.08, family=("apparel_trousers_mens",), heading=("6205", "6206")),
    Step(0.06, family=("apparel_trousers_mens",), heading=("6204", "6104")),
]
#: Candidates within a heading by family.  Fixed values.
FAMILY_STEPS = [
    Step(0.04, family=("electric_motor",), heading=("87",)),
    Step(plus=_A * 1.5, family=("electric_motor",), heading=("8501",)),
    Step(1.35, family=("electric_motor",), heading=("8501",), says=("motor",)),
    Step(0.05, any_term=("motor", "motors"), other_term=("electric", "electrical", "induction", "servo", "synchronous", "phase"), heading=("87",)),
    Step(1.4, any_term=("motor", "motors"), other_term=("electric", "electrical", "induction", "servo", "synchronous", "phase"), heading=("8501",)),
    Step(0.04, family=("furniture_office_chair", "furniture_office_desk", "furniture_cabinet", "furniture_shelving", "furniture_workstation"), heading=("9402",)),
    Step(plus=_S, family=("furniture_office_chair", "furniture_office_desk", "furniture_cabinet", "furniture_shelving", "furniture_workstation"), heading=("9401",)),
    Step(0.06, family=("stationery_pen",), no_family=("stationery_pen_refill",), text=("refills for ballpoint",)),
    Step(1.45, family=("stationery_pen",), no_family=("stationery_pen_refill",), text=("rolling ball", "ball-point")),
    Step(1.4, family=("stationery_pen_refill",), says=("refill",)),
    Step(plus=_A * 1.25, family=("office_printer_consumable",), heading=("3215",)),
    Step(0.04, family=("office_printer_consumable",), heading=("8443",)),
    Step(0.1, family=("power_supply", "ups"), text=("exceeding 500",)),
    Step(1.55, family=("pressure_sensor",), heading=("9026",), says=("pressure",)),
    Step(0.28, family=("pressure_sensor",), heading=("9026",), says=("flow meter",), says_none=("pressure",)),
    Step(1.6, family=("proximity_sensor",), heading=("8536",), says=("proximity", "inductive")),
    Step(0.7, family=("proximity_sensor",), heading=("8536",), says=("rotary switch", "push-button"), says_none=("proximity", "inductive")),
    Step(1.35, family=("photoelectric_sensor",), heading=("9031",)),
    Step(0.35, family=("photoelectric_sensor",), heading=("8536",)),
    Step(plus=_A * 1.4, family=("fastener_threaded_rod",), heading=("7318",)),
    Step(0.05, family=("fastener_threaded_rod",), heading=("7307",)),
    Step(plus=_A * 1.3, family=("food_prepared_meal",), heading=("2106", "1905")),
    Step(0.05, family=("food_prepared_meal",), heading=("2004",)),
    Step(plus=_A * 1.3, family=("shipping_container",), heading=("8609",)),
    Step(0.05, family=("shipping_container",), heading=("87",)),
    Step(plus=_A * 1.25, family=("food_pasta",), heading=("1902",)),
    Step(plus=_A, family=("polyurethane_compound",), heading=("3909",)),
    Step(plus=_S, family=("silicone_sealant",), heading=("3214",)),
    Step(plus=_S, family=("protective_coating_paint",), heading=("3209",)),
    Step(plus=_A * 1.2, family=("silicone_sealant",), heading=("3214",)),
    Step(0.15, family=("silicone_sealant",), heading=("3506",)),
    Step(plus=_A * 1.35, family=("wire_rope",), heading=("7312",)),
    Step(0.12, family=("wire_rope",), heading=("7313",)),
    Step(plus=_A * 1.25, family=("tool_steel_bars",), heading=("7228", "7224")),
    Step(plus=_A * 1.3, family=("food_aromatized_syrup",), heading=("2106",)),
    Step(plus=_S * 1.6, family=("furniture_fittings",), heading=("8302", "8308")),
    Step(1.35, family=("furniture_fittings",), heading=("8302", "8308"), text=("hinge", "bracket", "fitting", "mounting", "okovje")),
    Step(0.03, family=("furniture_fittings",), heading=("7318", "9403", "9405", "8304", "3926", "9401")),
    Step(plus=_A * 1.4, family=("industrial_adhesive",), heading=("3506",)),
    Step(0.04, family=("industrial_adhesive",), heading=("4821",)),
    Step(plus=_A * 1.35, family=("protective_coating_paint",), heading=("3209", "3210")),
    Step(0.05, family=("protective_coating_paint",), heading=("4810", "9701", "3212", "4821")),
    Step(0.04, family=("silicone_sealant",), heading=("3006",)),
    Step(plus=_A * 1.2, family=("software_media_disc",), heading=("8523",)),
]
#: Vehicles: what another chapter keeps, points of the chapter and of a hinted heading, factors of types.  Fixed values.
OTHER_CHAPTER, VEHICLE_CHAPTER, VEHICLE_HEADING = 0.04, 10.0, 7.0
VEHICLE_STEPS = [
    Step(1.15, family=("goods_vehicle",), heading=("8704", "8701")),
    Step(1.2, family=("tractor_unit",), heading=("8701",)),
    Step(1.25, family=("passenger_vehicle",), heading=("8703",)),
    Step(1.3, family=("trailer",), heading=("8716",)),
]
_CHAPTER = 9.0  # points of the sensors' chapter
_NEAR = ("inductive", "proximity")
#: Industrial goods, in order.  ``sensor`` and ``automation`` are kinds of a query, ``sensor:x`` is family x of a sensor; ``hinted``, ``penalised`` and ``excluded`` are told of a candidate.  Fixed values.
INDUSTRIAL_STEPS = [
    Step(plus=_CHAPTER, family=("sensor",), heading=("90",)),
    Step(plus=_S, family=("sensor:hinted",)),
    Step(1.25, family=("sensor:temperature_sensor",), says=("thermometer", "pyrometer")),
    Step(0.45, family=("sensor:proximity_sensor",), no_family=("sensor:temperature_sensor",), says=("thermometer", "pyrometer"), says_all=("clinical",)),
    Step(1.2, family=("sensor:pressure_sensor",), says_all=("pressure", "gauge")),
    Step(plus=_S * 1.85, family=("sensor:proximity_sensor",), heading=("8536",)),
    Step(plus=_S, family=("sensor:proximity_sensor",), heading=("9032",), says=_NEAR),
    Step(0.22, family=("sensor:proximity_sensor",), heading=("9032",), says_none=_NEAR),
    Step(0.1, family=("sensor:proximity_sensor",), heading=("9025", "9026"), says_none=_NEAR),
    Step(1.25, family=("sensor:proximity_sensor",), says=_NEAR),
    Step(plus=_A, family=("automation",), heading=("8537",)),
    Step(1.2, family=("automation",), heading=("8537",), says=("programmable", "controller")),
    Step(plus=_A * 1.2, family=("frequency_inverter",), heading=("8504",)),
    Step(plus=_A, family=("power_supply",), heading=("8504",)),
    Step(0.05, family=("ups",), heading=("8543",)),
    Step(0.04, family=("ups",), heading=("8536",)),
    Step(0.15, family=("ups",), heading=("8536",), says=("battery", "clamp")),
    Step(plus=_A * 1.55, family=("ups",), heading=("8504",)),
    Step(1.35, family=("ups",), heading=("8504",), says=("uninterruptible", "static", "converter")),
    Step(plus=_S * 1.2, family=("electronics_monitor",), heading=("8528",)),
    Step(plus=_A * 1.3, family=("stationery_marker",), heading=("9608",), says=("marker", "pen")),
    Step(0.06, family=("stationery_marker",), heading=("9612",)),
    Step(0.06, family=("stationery_marker",), not_heading=("9612",), says=("ribbon",)),
    Step(0.08, family=("frequency_inverter",), says=("diesel", "compression-ignition"), says_none=("inverter", "static")),
    Step(plus=_A * 1.3, family=("electric_motor",), heading=("8501",)),
    Step(0.05, family=("electric_motor",), heading=("87",)),
    Step(plus=_S, family=("furniture_office_chair",), heading=("9401",)),
    Step(plus=_A, family=("office_printer_consumable",), heading=("3215",)),
    Step(0.05, family=("office_printer_consumable",), heading=("8443",)),
    Step(0.03, family=("penalised",)),
    Step(0.05, family=("excluded",)),
]


def _holds(step: Step, terms: Column, families: Column, heading: Column, says: Column, text: Column) -> Column:
    named = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")

    def some(test, xs: Sequence[str]) -> Column:
        out = F.lit(False)
        for x in xs:
            out = out | test(x)
        return out

    out = F.lit(True)
    for xs in (step.any_term, step.other_term):
        out = out & F.arrays_overlap(terms, named(xs)) if xs else out
    if step.all_terms:
        out = out & (F.size(F.array_except(named(step.all_terms), terms)) == 0)
    if step.no_term:
        out = out & ~F.arrays_overlap(terms, named(step.no_term))
    if step.family:
        out = out & F.arrays_overlap(families, named(step.family))
    if step.no_family:
        out = out & ~F.arrays_overlap(families, named(step.no_family))
    if step.heading:
        out = out & some(heading.startswith, step.heading)
    if step.not_heading:
        out = out & ~some(heading.startswith, step.not_heading)
    if step.says:
        out = out & some(says.contains, step.says)
    for x in step.says_all:
        out = out & says.contains(x)
    if step.says_none:
        out = out & ~some(says.contains, step.says_none)
    return out & some(text.contains, step.text) if step.text else out


def applied(score: Column, steps: Sequence[Step], terms: Column, families: Column, heading: Column, says: Column, text: Column | None = None) -> Column:
    """The score after all steps in order; terms and families are arrays, texts are lower case."""
    text = says if text is None else text
    if not steps:
        return score
    told = F.struct(terms.alias("terms"), families.alias("families"), heading.alias("heading"), says.alias("says"), text.alias("text"))

    def factors(x: Column) -> Column:
        each = (F.when(_holds(s, x["terms"], x["families"], x["heading"], x["says"], x["text"]), F.struct(F.lit(float(s.times)).alias("times"), F.lit(float(s.plus)).alias("plus"))) for s in steps)
        return F.array_compact(F.array(*each))

    return F.aggregate(once(told, factors), score.cast("double"), lambda x, s: x * s["times"] + s["plus"])


def vehicle(score: Column, types: Column, heading: Column, hints: Column, condition: Column, says: Column) -> Column:
    """A vehicle's score: other chapters keep a trifle; chapter 87, hinted headings, the condition and the kind of vehicle raise it."""
    base = score + VEHICLE_CHAPTER + F.when(F.array_contains(hints, heading), VEHICLE_HEADING).otherwise(0.0)
    condition = F.when((condition == "used") & says.contains("used"), 1.3).when((condition == "new") & says.rlike(r"\bnew\b"), 1.2).otherwise(1.0)
    none = F.array().cast("array<string>")
    return F.when(~heading.startswith("87"), score * OTHER_CHAPTER).otherwise(applied(base * F.coalesce(condition, F.lit(1.0)), VEHICLE_STEPS, none, types, heading, says))


def industrial(score: Column, sensor: Column, automation: Column, families: Column, heading: Column, hints: Column, penalised: Column, matched: Column, excluded: Column, says: Column) -> Column:
    """The score of a candidate for industrial goods: points of chapters and headings by kind and family, then factors of false headings and of matches by model words alone.

    families, hints and penalised (headings of four digits), matched (the query's terms found in the candidate) and excluded (terms that are but a model's) are arrays; heading is of four digits,
    says in lower case.  Nulls count as no or none; a null score stays null.
    """
    none = F.array().cast("array<string>")
    families, hints, penalised, matched, excluded = (F.coalesce(x, none) for x in (families, hints, penalised, matched, excluded))
    heading, says = F.coalesce(heading, F.lit("")), F.coalesce(says, F.lit(""))
    told = F.array_compact(F.array(
        F.when(sensor, "sensor"), F.when(sensor & F.array_contains(hints, heading), "sensor:hinted"), F.when(automation, "automation"), F.when(F.array_contains(penalised, heading), "penalised"),
        F.when((F.size(matched) > 0) & (F.size(F.array_except(matched, excluded)) == 0), "excluded"),
    ))
    own = F.when(sensor, F.transform(families, lambda x: F.concat(F.lit("sensor:"), x))).otherwise(none)
    return applied(score, INDUSTRIAL_STEPS, none, F.concat(told, families, own), heading, says)
