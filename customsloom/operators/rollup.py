"""Roll-ups of invoice lines by tariff code and preferential origin, and allocations with exact remainders.

Lines have the columns invoice_id, position, hs_code, quantity, line_total, country, preference and net_weight (null where
unknown), as ``plans.bindings.lines`` makes them.  Each roll-up is one grouped aggregation, so that Spark sums partly before
it shuffles; keys that hold much of the data cost a row a task in the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.numbers import round_money, round_weight
from customsloom.functions.tariff import of_map
from customsloom.functions.text import is_metadata, line_type


def goods(lines: DataFrame) -> DataFrame:
    """Lines of goods with a code."""
    return lines.where((line_type(F.col("description")) == "GOODS") & ~is_metadata(F.col("description")) & (F.coalesce(F.col("hs_code"), F.lit("")) != ""))


def _sorted(column: str, kind: str | None = None) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_set(column)), lambda x: x.cast("string")), ", ")


def _sums(positive_weight: bool = False) -> list[Column]:
    weight = F.sum("net_weight")
    weight = F.when(weight > 0, round_weight(weight)) if positive_weight else round_weight(weight)
    return [round_money(F.sum("quantity")).alias("total_quantity"), round_money(F.sum("line_total")).alias("total_value"), weight.alias("total_net_weight"), F.count("*").alias("item_count")]


def by_preference(lines: DataFrame, *keys: str) -> DataFrame:
    """Per code and preference: sums (weight null if unknown or not positive), lines and countries of origin."""
    return lines.groupBy(*keys, "hs_code", "preference").agg(*_sums(True), _sorted("country").alias("countries_of_origin"))


def by_code(lines: DataFrame, *keys: str) -> DataFrame:
    """Per code alone."""
    return lines.groupBy(*keys, "hs_code").agg(*_sums(True), _sorted("country").alias("countries_of_origin"))


def preference_bucket(lines: DataFrame, status: str, *keys: str) -> DataFrame:
    """Per code the lines of one preference; weights that aren't positive stay."""
    return lines.where(F.col("preference") == status).groupBy(*keys, "hs_code").agg(*_sums())


def preference_buckets(lines: DataFrame, *keys: str) -> DataFrame:
    """Per code the sums of each preference side by side."""
    parts = []
    for status, name in (("YES", "preferential"), ("NO", "non_preferential"), ("NOT_DECLARED", "unknown")):
        own = F.col("preference") == status
        parts += [F.count_if(own).alias(f"{name}_lines"), F.coalesce(round_money(F.sum(F.when(own, F.col("line_total")))), F.lit(0.0)).alias(f"{name}_value"), round_weight(F.sum(F.when(own, F.col("net_weight")))).alias(f"{name}_weight")]
    return lines.groupBy(*keys, "hs_code").agg(*parts)


def collapsed_bucket(lines: DataFrame, shipment_weight: Column, *keys: str) -> DataFrame:
    """All lines as one row; the shipment's weight stands in where no line has one."""
    weight = F.coalesce(F.sum("net_weight"), shipment_weight)
    return lines.groupBy(*keys).agg(round_money(F.sum("line_total")).alias("total_value"), round_money(F.sum("quantity")).alias("total_quantity"), round_weight(weight).alias("total_net_weight"))


def declaration_summary(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines, code-and-preference pairs (unique_hs_codes), distinct codes, value, weight and countries."""
    return lines.groupBy(*keys).agg(
        F.count("*").alias("total_goods_lines"),
        # sets and not count_distinct, for which Spark would send each line three times
        F.size(F.collect_set(F.when(F.col("hs_code").isNotNull() & F.col("preference").isNotNull(), F.struct("hs_code", "preference")))).cast("bigint").alias("unique_hs_codes"),
        F.size(F.collect_set("hs_code")).cast("bigint").alias("distinct_hs_codes"),
        round_money(F.sum("line_total")).alias("total_invoice_value"),
        round_weight(F.sum("net_weight")).alias("total_net_weight"),
        _sorted("country").alias("countries_of_origin"),
    )


def allocate(rows: DataFrame, total: Column, value: str, order: str, *keys: str, name: str = "allocated") -> DataFrame:
    """Splits ``total`` by the share of ``value``, rounded to 3 digits; the last row by ``order`` takes what is left."""
    run = Window.partitionBy(*keys).orderBy(order)
    group = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the same order, so that rows are sorted once
    out = rows.withColumns({"_all": F.sum(value).over(group), "_n": F.count("*").over(group), "_at": F.row_number().over(run)})
    out = out.withColumn("_share", round_weight(total * F.col(value) / F.when(F.col("_all") > 0, F.col("_all"))))
    before = F.coalesce(F.sum("_share").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    part = F.when(F.col("_n") == 1, round_weight(total)).when(F.col("_at") == F.col("_n"), round_weight(total - before)).otherwise(F.col("_share"))
    return out.withColumn(name, F.when((F.col("_n") == 1) | (F.col("_all") > 0), part)).drop("_all", "_n", "_at", "_share")


def preferential_allocation(lines: DataFrame, totals: DataFrame, key: str = "invoice_id", ratio: float = 1.5) -> DataFrame:
    """Per invoice the preferential and other quantity, value and weight; values far from ``canonical_total`` are scaled to it.

    ``totals`` has the key, canonical_total and shipment_weight.  A side without line weights gets the shipment's by value.
    """
    yes, no = F.col("preference") == "YES", F.col("preference") == "NO"
    sums = lines.groupBy(key).agg(
        F.count_if(yes).alias("yes_lines"), F.count_if(no).alias("no_lines"),
        F.coalesce(F.sum(F.when(yes, F.col("quantity"))), F.lit(0.0)).alias("yes_quantity"), F.coalesce(F.sum(F.when(no, F.col("quantity"))), F.lit(0.0)).alias("no_quantity"),
        F.coalesce(F.sum(F.when(yes, F.col("line_total"))), F.lit(0.0)).alias("yes_value"), F.coalesce(F.sum(F.when(no, F.col("line_total"))), F.lit(0.0)).alias("no_value"),
        F.sum(F.when(yes, F.col("net_weight"))).alias("yes_weight"), F.sum(F.when(no, F.col("net_weight"))).alias("no_weight"),
    ).where("yes_lines + no_lines > 0").join(totals, key)
    both = F.col("yes_value") + F.col("no_value")
    far = (F.col("canonical_total") > 0) & (both > 0) & (F.greatest(both, "canonical_total") / F.least(both, "canonical_total") > ratio)
    scale = F.when(far, F.col("canonical_total") / both).otherwise(1.0)
    out = sums.withColumns({"preferential_value": round_money(F.col("yes_value") * scale), "non_preferential_value": round_money(F.col("no_value") * scale)})
    classified = F.col("preferential_value") + F.col("non_preferential_value")

    def weight(side: str, value: str) -> Column:
        shared = F.when((F.col("shipment_weight") > 0) & (classified > 0) & (F.col(value) > 0), round_weight(F.col("shipment_weight") * F.col(value) / classified))
        return F.coalesce(round_weight(F.col(side)), shared)

    return out.select(
        key, ((F.col("yes_lines") > 0) & (F.col("no_lines") > 0)).alias("is_mixed"), F.col("yes_quantity").alias("preferential_quantity"), "preferential_value", weight("yes_weight", "preferential_value").alias("preferential_weight"),
        F.col("no_quantity").alias("non_preferential_quantity"), "non_preferential_value", weight("no_weight", "non_preferential_value").alias("non_preferential_weight"),
    )


def line_weights(lines: DataFrame, totals: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Line weights summed as they are and times quantity, with a flag where either is over 1.1 times the gross weight.

    ``totals`` has the key and gross_weight.  Without a gross weight the sum times quantity counts if it is over 1.2 times the other.
    """
    weighed = F.col("net_weight").isNotNull()
    each = F.when(weighed, F.col("net_weight") * F.greatest(F.coalesce("quantity", F.lit(1.0)), F.lit(1.0)))
    sums = lines.groupBy(key).agg(F.sum("net_weight").alias("raw_line_sum"), F.sum(each).alias("unit_adjusted_sum"), F.max(weighed & (F.col("quantity") > 1)).alias("several")).join(totals, key)
    gross = F.coalesce(F.col("gross_weight") > 0, F.lit(False))
    misuse = gross & (F.greatest("raw_line_sum", "unit_adjusted_sum") > F.col("gross_weight") * 1.1)
    total = F.when(~gross & F.col("several") & (F.col("unit_adjusted_sum") > F.col("raw_line_sum") * 1.2), F.col("unit_adjusted_sum")).otherwise(F.col("raw_line_sum"))
    return sums.select(key, round_weight(F.col("raw_line_sum")).alias("raw_line_sum"), round_weight(F.col("unit_adjusted_sum")).alias("unit_adjusted_sum"), round_weight(total).alias("net_weight_total"), F.coalesce(misuse, F.lit(False)).alias("unit_weight_misuse"))


def origin_countries(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines of goods by country of origin."""
    return lines.where(line_type(F.col("description")) == "GOODS").groupBy(*keys, "country").agg(F.count("*").alias("line_count"))


def aggregation_unit(lines: DataFrame, unit: str, *keys: str) -> DataFrame:
    """The most frequent unit of a group, the first by name of equally frequent ones, PCS where none is known."""
    counts = lines.groupBy(*keys, unit).agg(F.count(unit).alias("n"))
    return counts.groupBy(*keys).agg(F.coalesce(F.min_by(unit, F.struct((-F.col("n")).alias("a"), F.col(unit).isNull().alias("b"), F.col(unit).alias("c"))), F.lit("PCS")).alias("unit"))


def status_of(lines: DataFrame, *keys: str) -> DataFrame:
    """The preference all lines of a group share, MIXED if they differ, UNKNOWN of none."""
    seen = F.array_sort(F.collect_set("preference"))
    return lines.groupBy(*keys).agg(F.when(F.size(seen) == 0, "UNKNOWN").when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise("MIXED").alias("preference_status"))


def traceability(rollup: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each roll-up row: by code and preference (equi-join; no list of positions is exploded)."""
    return rollup.select("hs_code", "preference").join(lines, ["hs_code", "preference"])


#: Code of the one row that stands for the goods of an invoice without any declaration of preference.  Fixed value.
EXPORT_CODE = "NON_PREFERENTIAL_EXPORT"
_SECTIONS = {"YES": "preferential", "NO": "non_preferential"}


def tariff_groups(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Lines of an invoice by kind, code and preference with their sums, the one table that ``tariff_report`` and ``invoice_summary`` start from.

    kind is GOODS (goods with a code), LINE (goods without one, and lines of data about the invoice) or SERVICE (services and packaging); code and
    preference are null but for GOODS, where a null preference is NOT_DECLARED.  A group is a row whatever its number of lines.
    """
    named = F.coalesce(F.trim("hs_code"), F.lit("")) != ""
    kind = F.when(line_type(F.col("description")) != "GOODS", "SERVICE").when(named & ~is_metadata(F.col("description")), "GOODS").otherwise("LINE")
    own = F.col("kind") == "GOODS"
    rows = lines.withColumn("kind", kind).withColumns({"hs_code": F.when(own, F.trim("hs_code")), "preference": F.when(own, F.coalesce("preference", F.lit("NOT_DECLARED")))})
    filled = F.when(F.trim("country") != "", F.col("country"))
    return rows.groupBy(key, "kind", "hs_code", "preference").agg(
        F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("quantity"), F.coalesce(F.sum("line_total"), F.lit(0.0)).alias("value"), F.sum("net_weight").alias("weight"), F.count("*").alias("n"), F.array_sort(F.collect_set(filled)).alias("countries"),
    )


def tariff_report(groups: DataFrame, documents: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The whole roll-up of each invoice, a row per section and code, from ``tariff_groups`` and documents (key, shipment_weight).

    Sections: codes (per code and preference; weights that aren't positive are unknown), preferential, non_preferential and unknown (per code; the last
    also per status).  Of an invoice whose goods are all NOT_DECLARED, non_preferential is one row of EXPORT_CODE with the shipment's weight where no line has
    one, and unknown is empty.  Where no line has a weight, the shipment's is dealt by value if all goods are preferential or all are not (the last code
    takes the remainder; codes get their rounded share); if there are both, weight_unavailable is true outside of codes.  An invoice without goods has no rows; a share of no
    value is null; documents must have one row a key, and an invoice without one has no shipment's weight.
    """
    goods_ = groups.where("kind = 'GOODS'").drop("kind").join(documents.select(key, F.col("shipment_weight").cast("double").alias("_ship")), key, "left")
    all_ = Window.partitionBy(key).orderBy("hs_code").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of allocate
    of = lambda status: F.sum(F.when(F.col("preference") == status, F.col("n")).otherwise(0)).over(all_)
    rows = goods_.withColumns({"_lines": F.sum("n").over(all_), "_yes": of("YES"), "_no": of("NO"), "_none": of("NOT_DECLARED"), "_value": F.sum("value").over(all_), "_quantity": F.sum("quantity").over(all_), "_weight": F.sum("weight").over(all_), "_place": F.row_number().over(Window.partitionBy(key).orderBy("hs_code"))})
    rows = rows.withColumns({"_weighed": F.col("_weight").isNotNull(), "total_value": round_money(F.col("value")), "total_quantity": round_money(F.col("quantity")), "_sum": round_weight(F.col("weight"))})
    dealt = F.col("_ship").isNotNull() & ~F.col("_weighed")
    alone = dealt & ((F.col("_yes") == F.col("_lines")) | (F.col("_no") == F.col("_lines")))  # then a code is one group
    rows = allocate(rows, F.col("_ship"), "total_value", "hs_code", key, name="_part")
    share = round_weight(F.col("_ship") * F.col("total_value") / F.when(F.col("_value") != 0, F.col("_value")))
    undeclared = F.col("_none") == F.col("_lines")
    section = F.when(undeclared, F.lit(None)).otherwise(F.coalesce(of_map(F.col("preference"), _SECTIONS), F.lit("unknown")))
    weights = {"codes": F.when(alone, share).otherwise(F.when(F.col("weight") > 0, F.col("_sum"))), "own": F.when(alone, F.col("_part")).otherwise(F.col("_sum"))}
    mixed = dealt & (F.col("_yes") > 0) & (F.col("_no") > 0)
    whole = undeclared & (F.col("_place") == 1)  # the one row of such an invoice is told by its first group
    seen = F.collect_set(F.when(undeclared, F.col("countries"))).over(all_)  # distinct lists, of few countries; not kept in a window that others are worked out from
    rows = rows.withColumn("_seen", F.when(whole, F.array_join(F.array_sort(F.array_distinct(F.flatten(seen))), ", ")))
    one = lambda kind, section, weight, unavailable: F.struct(F.lit(kind).alias("_kind"), section.alias("section"), weight.alias("total_net_weight"), unavailable.alias("weight_unavailable"))
    parts = F.array(one(0, F.lit("codes"), weights["codes"], F.lit(False)), one(1, section, weights["own"], mixed), one(2, F.when(whole, "non_preferential"), round_weight(F.coalesce("_weight", "_ship")), F.lit(False)))
    each = rows.withColumn("_countries", F.array_join("countries", ", ")).select("*", F.inline(parts)).where("section IS NOT NULL")
    or_whole = lambda own, value: F.when(F.col("_kind") == 2, value).otherwise(F.col(own)).alias(own)
    return each.select(
        key, "section", or_whole("hs_code", F.lit(EXPORT_CODE)), or_whole("preference", F.lit("NOT_DECLARED")), or_whole("total_quantity", round_money(F.col("_quantity"))), or_whole("total_value", round_money(F.col("_value"))),
        "total_net_weight", "weight_unavailable", or_whole("n", F.col("_lines")).alias("item_count"), or_whole("_countries", F.col("_seen")).alias("countries_of_origin"),
    )


def invoice_summary(groups: DataFrame, documents: DataFrame, key: str = "invoice_id") -> DataFrame:
    """One row an invoice with lines, from ``tariff_groups`` and documents (key, shipment_weight, gross_weight, canonical_total).

    total_goods_lines counts all lines but services and packaging, unique_hs_codes pairs of code and preference, excluded_service_lines the others.  The document's total
    goes before the goods' sum where it is positive; its weight stands in where no goods have one.
    """
    own = F.col("kind") == "GOODS"
    sums = groups.groupBy(key).agg(
        F.sum(F.when(F.col("kind") != "SERVICE", F.col("n")).otherwise(0)).alias("total_goods_lines"), F.count_if(own).alias("unique_hs_codes"), F.coalesce(F.sum(F.when(own, F.col("value"))), F.lit(0.0)).alias("_value"), F.sum(F.when(own, F.col("weight"))).alias("_weight"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(own, F.col("countries")))))), ", ").alias("countries_of_origin"), F.sum(F.when(F.col("kind") == "SERVICE", F.col("n")).otherwise(0)).alias("excluded_service_lines"),
    )
    rows = sums.join(documents.select(key, F.col("shipment_weight").alias("_ship"), F.col("gross_weight").alias("_gross"), F.col("canonical_total").alias("_total")), key, "left")
    return rows.select(
        key, "total_goods_lines", "unique_hs_codes", round_money(F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.col("_value"))).alias("total_invoice_value"), round_weight(F.coalesce("_weight", "_ship")).alias("total_net_weight"),
        round_weight(F.col("_gross")).alias("total_gross_weight"), "countries_of_origin", "excluded_service_lines",
    )
