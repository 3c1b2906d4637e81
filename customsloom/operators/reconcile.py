"""Totals against lines, chains of position numbers, duplicates, and matches between sources of the same lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.numbers import round_money

#: Shares up to which a difference passes and warns; ratio from which two totals don't describe one thing.
PASS, WARNING, APART = 0.01, 0.05, 1.5


def relative_difference(a: Column, reference: Column) -> Column:
    return F.abs(a - reference) / F.greatest(F.abs(reference), F.lit(0.01))


def line_sum(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Per invoice the sum of line totals (price times quantity where a total is missing); null if no line has either."""
    value = F.coalesce("line_total", F.col("unit_price") * F.col("quantity")) if "unit_price" in lines.columns else F.col("line_total")
    return lines.groupBy(key).agg(round_money(F.sum(value)).alias("calculated_total"))


def totals(sums: DataFrame, invoices: DataFrame, key: str = "invoice_id") -> DataFrame:
    """calculated_total beside total_value: difference, its share, and PASS, WARNING or FAIL."""
    both = invoices.join(sums, key, "left")
    usable = F.coalesce(F.col("calculated_total") > 0, F.lit(False)) & F.coalesce(F.col("total_value") > 0, F.lit(False))
    ratio = F.when(usable, relative_difference(F.col("calculated_total"), F.col("total_value")))
    status = F.when(ratio.isNull() | ((ratio > PASS) & (ratio <= WARNING)), "WARNING").when(ratio <= PASS, "PASS").otherwise("FAIL")
    return both.select(key, F.col("total_value").alias("invoice_total"), "calculated_total", F.when(usable, round_money(F.abs(F.col("calculated_total") - F.col("total_value")))).alias("difference"), status.alias("validation_status"))


def canonical_total(header: Column, lines: Column) -> Column:
    """The header, but the smaller one where header and line sum are more than 1.5 apart; whichever is there if only one is."""
    apart = F.greatest(header, lines) > F.least(header, lines) * APART
    return F.when((header > 0) & (lines > 0), round_money(F.when(apart, F.least(header, lines)).otherwise(header))).when(header > 0, header).when(lines > 0, lines).otherwise(F.lit(0.0))


def largest_deviation(values: Column) -> Column:
    """The largest relative deviation between two of an array of totals, over the larger of each pair."""
    known = F.filter(values, lambda v: v > 0)
    pairs = F.transform(known, lambda a: F.array_max(F.transform(known, lambda b: F.abs(a - b) / F.greatest(a, b))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def missing_positions(lines: DataFrame, key: str = "invoice_id", position: str = "position", first: str = "min") -> DataFrame:
    """Numbers that a chain leaves out between its first (``min``: its own least, ``one``: 1) and its largest number."""
    spans = lines.groupBy(key).agg(F.min(position).alias("lo"), F.max(position).alias("hi"))
    start = F.col("lo") if first == "min" else F.least(F.lit(1), F.col("hi"))
    expected = spans.select(key, F.explode(F.sequence(start.cast("int"), F.col("hi").cast("int"))).alias(position))
    return expected.join(lines.select(key, F.col(position).cast("int").alias(position)).distinct(), [key, position], "left_anti")


def sequence_breaks(lines: DataFrame, key: str = "invoice_id", position: str = "position") -> DataFrame:
    """Where a sorted chain jumps by more than one."""
    before = F.lag(position).over(Window.partitionBy(key).orderBy(position))
    return lines.select(key, F.col(position), before.alias("previous")).where(F.col(position) - F.col("previous") > 1)


def duplicate_positions(lines: DataFrame, key: str = "invoice_id", position: str = "position") -> DataFrame:
    return lines.groupBy(key, position).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def identity_key(position: Column, *texts: Column, quantity: Column, line_total: Column, unit_price: Column) -> Column:
    """What makes two lines the same: position, texts, and the figures to 3, 2 and 4 digits."""
    return F.concat_ws("|", position.cast("string"), *(F.coalesce(t, F.lit("")) for t in texts), F.round(quantity, 3).cast("decimal(20,3)").cast("string"), F.round(line_total, 2).cast("decimal(20,2)").cast("string"), F.round(unit_price, 4).cast("decimal(20,4)").cast("string"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``, and how many it stands for."""
    by = Window.partitionBy(*keys)
    return rows.withColumns({"_at": F.row_number().over(by.orderBy(*order)), "copies": F.count("*").over(by)}).where("_at = 1").drop("_at")


def renumber(rows: DataFrame, key: str, order: list[str], name: str = "position") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def collapse_blocks(lines: DataFrame, sizes: DataFrame, key: str = "invoice_id", order: str = "ord", identity: str = "identity") -> DataFrame:
    """The first block of an invoice that consists of equal blocks of ``block`` lines (from ``sizes``), renumbered; others stay as they are."""
    numbered = lines.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).join(sizes.select(key, "block"), key, "left")
    slots = numbered.withColumn("_slot", F.when(F.col("block") > 0, F.col("_i") % F.col("block")))
    whole = slots.groupBy(key, "_slot").agg(F.count_distinct(identity).alias("d"), F.count("*").alias("c"), F.max("block").alias("b"))
    whole = whole.groupBy(key).agg((F.max("d") == 1).alias("same"), F.sum("c").alias("n"), F.max("b").alias("b"))
    whole = whole.select(key, (F.col("same") & (F.col("b") > 0) & (F.col("n") % F.col("b") == 0) & (F.col("n") >= 2 * F.col("b"))).alias("collapse"))
    out = slots.join(whole, key).where(~F.coalesce("collapse", F.lit(False)) | (F.col("_i") < F.col("block")))
    return out.withColumn("position", F.col("_i") + 1).drop("_i", "_slot", "block", "collapse")


def match_source(source: DataFrame, extracted: DataFrame, key: str = "invoice_id") -> DataFrame:
    """For each source line (key, position, style) the extracted line (key, ord, position, style) at its place with its style, else the first of its style, else the one of its position.

    The tiers are three joins; the first of a style or position is found before joining, so no pair of lines is formed twice.
    """
    first_style = extracted.groupBy(key, "style").agg(F.min("ord").alias("style_ord"))
    first_position = extracted.groupBy(key, "position").agg(F.min("ord").alias("position_ord"))
    at_place = extracted.select(key, "style", F.col("ord").alias("position"), F.col("ord").alias("place_ord"))
    out = source.join(at_place, [key, "style", "position"], "left").join(first_style, [key, "style"], "left").join(first_position, [key, "position"], "left")
    return out.select(key, "position", "style", F.coalesce("place_ord", "style_ord", "position_ord").alias("matched_ord"), F.when(F.col("place_ord").isNotNull(), "STYLE_AT_INDEX").when(F.col("style_ord").isNotNull(), "STYLE").when(F.col("position_ord").isNotNull(), "POSITION").otherwise("NONE").alias("match_tier"))


def trace_stages(lines: int, key: str = "invoice_id", **stages: DataFrame) -> DataFrame:
    """Stages of the same lines side by side by position, with a flag for each that isn't there; drives from 1 to the longest."""
    longest = None
    for d in stages.values():
        own = d.groupBy(key).agg(F.max("position").alias("n"))
        longest = own if longest is None else longest.unionAll(own)
    out = longest.groupBy(key).agg(F.max("n").alias("n")).select(key, F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))).alias("position"))
    for name, d in stages.items():
        out = out.join(d.groupBy(key, "position").agg(F.min("value").alias(f"{name}_value")), [key, "position"], "left").withColumn(f"in_{name}", F.col(f"{name}_value").isNotNull())
    return out


def dice_pairs(rows: DataFrame, block: list[str], id_col: str, text_col: str, least: float = 0.95) -> DataFrame:
    """Pairs of similar texts that agree in the ``block`` columns; texts of equal form meet once, so copies aren't paired.

    Similar texts share at least ``least`` / (2 - ``least``) of the letter pairs of either, and one that holds another shares all of
    the other's.  So every text is met by its rarest letter pairs alone, as many as it could lack and one, among all letter pairs
    of the others; what meets is compared.
    """
    from customsloom.functions.text import bigrams, dice, squeezed

    distinct = rows.select(*block, squeezed(F.col(text_col)).alias("text"), F.col(id_col).alias("id")).groupBy(*block, "text").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    held = distinct.select(*block, "id", F.explode(bigrams(F.col("text"))).alias("pair"))
    common = held.groupBy(*block, "pair").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*block, "id")
    ranked = held.join(common, [*block, "pair"]).withColumns({"k": F.row_number().over(own.orderBy("n", "pair")), "size": F.count("*").over(own)})
    few = ranked.where(F.col("k") <= F.col("size") - F.ceil(F.col("size") * (least / (2 - least)) - 1e-9) + 1).select(*block, "pair", F.col("id").alias("a"))
    met = few.join(held.withColumnRenamed("id", "b"), [*block, "pair"]).where("a != b").select(*block, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
    text = lambda side: distinct.select(*block, F.col("id").alias(f"id_{side}"), F.col("text").alias(f"text_{side}"))
    both = met.join(text("a"), [*block, "id_a"]).join(text("b"), [*block, "id_b"])
    return both.select(*block, "id_a", "id_b", dice(F.col("text_a"), F.col("text_b")).alias("similarity")).where(F.col("similarity") >= least)
