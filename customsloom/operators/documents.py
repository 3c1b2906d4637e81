"""Facts of whole documents: weights and destination by priority, the invoice's value, totals and fields in text, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from customsloom.functions.numbers import once, parse_locale_number, round_money
from customsloom.functions.tariff import normalise

#: Totals that differ by more than this factor aren't of one invoice.  Fixed value.
DIVERGENCE = 1.5
#: Labels of an amount in euros, in the order in which they are tried.  Fixed values.
AMOUNT_EUR = [
    r"(?i)total\s+amount\s+eur\s*[:\s]*(?:EUR|€)?\s*([\d.,\s]+)", r"(?i)amount\s*eur\s*[:\s]*(?:EUR|€)?\s*([\d.,\s]+)", r"(?i)eur\s+amount\s*[:\s]*(?:EUR|€)?\s*([\d.,\s]+)",
    r"(?i)gesamt\s*eur\s*[:\s]*(?:EUR|€)?\s*([\d.,\s]+)", r"(?i)total\s+eur\s*[:\s]*(?:EUR|€)?\s*([\d.,\s]+)",
]
#: Columns of a table of totals, by their labels.  Fixed values.
TOTAL_COLUMNS = {"amount": r"(?i)\b(?<![\w])amount(?!\s+to\s+be)(?!\s+eur)\b", "discount": r"(?i)\b(?:discount|popust|rabatt|skonto)\b", "vat_amount": r"(?i)\bv(?:at)?\s*amount\b", "total_invoice_amount": r"(?i)\btotal\s+invoice\s+amount\b", "amount_to_be_paid": r"(?i)\bamount\s+to\s+be\s+paid\b"}
MONEY = r"(\d{1,3}(?:[.,\s]\d{3})*[.,]\d{2}|\d+[.,]\d{2})(?!\d)"
#: Sources of a declaration's description, the one that counts most first.  Fixed values.
DESCRIPTION_SOURCES = ["user_edited", "hs_library", "ai_generated", "rule_based"]


def _positive(x: Column) -> Column:
    return F.coalesce(x > 0, F.lit(False))


def weights(existing_net: Column, existing_gross: Column, source: Column, document_net: Column, document_gross: Column, line_net: Column) -> dict[str, Column]:
    """net and gross with their sources, and whether unit weights were taken for totals.

    Gross: the stated one, else the document's.  Net: a stated one that isn't calculated (nor above a known gross, unless its source is a document), else the
    document's, else the lines' sum if there is no gross.
    """
    gross = F.when(_positive(existing_gross), existing_gross).when(_positive(document_gross), document_gross)
    gross_source = F.when(_positive(existing_gross), "DOCUMENT").when(_positive(document_gross), "OCR_TEXT")
    stated = F.coalesce(source.isin("DOCUMENT", "OCR_TEXT", "OCR_TABLE"), F.lit(False))
    above = F.coalesce(existing_net > gross, F.lit(False))
    own = stated | (source.isNull() & _positive(existing_net) & ~above)
    net = F.when(own, existing_net).when(_positive(document_net), document_net).when(gross.isNull() & _positive(line_net), line_net)
    net_source = F.when(own, F.coalesce(source, F.lit("DOCUMENT"))).when(_positive(document_net), "OCR_TEXT").when(gross.isNull() & _positive(line_net), "CALCULATED")
    documented = (_positive(existing_net) & stated) | _positive(document_net)
    misuse = (~own & ~_positive(document_net) & gross.isNotNull() & F.coalesce(line_net > gross * 1.1, F.lit(False))) | (documented & F.coalesce(net > gross, F.lit(False)))
    return {"net": net, "net_source": net_source, "gross": gross, "gross_source": gross_source, "unit_weight_misuse": misuse}


def destination(consignee: Column, exporter: Column, stated: Column, terms_place: Column) -> tuple[Column, Column]:
    """(country, source): of codes, the first consignee's that isn't the exporter's, else the first consignee's; else the stated country if it isn't the exporter's; else that of the terms' place.

    ``consignee`` is an array of the countries of the consignee's addresses.
    """
    abroad = F.filter(consignee, lambda c: c.isNotNull() & (exporter.isNotNull() & (c != exporter)))
    known = F.filter(consignee, lambda c: c.isNotNull())
    own = F.coalesce(F.get(abroad, F.lit(0)), F.get(known, F.lit(0)))
    named = F.when(stated.isNotNull() & ~stated.eqNullSafe(exporter), stated)
    place = F.when(terms_place.isNotNull() & ~terms_place.eqNullSafe(exporter), terms_place)
    source = F.when(own.isNotNull(), "consignee").when(named.isNotNull(), "ocr_country_field").when(place.isNotNull(), "incoterms_place").otherwise("unresolved")
    return F.coalesce(own, named, place), source


def amount_eur(text: Column) -> Column:
    """The first labelled amount in euros above 0."""
    found = [round_money(parse_locale_number(F.regexp_extract(text, p, 1))) for p in AMOUNT_EUR]
    return F.coalesce(*(once(x, lambda y: F.when(y > 0, y)) for x in found))


def amounts(line: Column) -> Column:
    """All amounts of money in a line."""
    return F.transform(F.regexp_extract_all(line, F.lit(MONEY), 1), lambda x: round_money(parse_locale_number(x)))


def tabular_total(text: Column) -> Column:
    """The invoice's total from a row of labels with the amounts in the row below; null without one.

    Three amounts of which the first less the second is the third speak for themselves; else the amount under the total's label,
    else under that of the sum to be paid.
    """
    pattern = r"(?i)(?:^|\n)([^\n]*\btotal\s+invoice\s+amount\b[^\n]*)\n\s*([^\n]+)"
    found = F.struct(F.regexp_extract(text, pattern, 1).alias("head"), amounts(F.regexp_extract(text, pattern, 2)).alias("values"))
    return once(found, lambda x: F.when(x["head"] != "", once(F.struct(*(F.regexp_instr(x["head"], F.lit(p)).alias(k) for k, p in TOTAL_COLUMNS.items())), lambda at: _total(at, x["values"]))))


def _total(at: Column, values: Column) -> Column:
    def under(name: str) -> Column:
        before = sum(((at[k] > 0) & (at[k] < at[name])).cast("int") for k in TOTAL_COLUMNS if k != name)
        return once(F.get(values, before), lambda value: F.when((at[name] > 0) & (value > 0), value))

    def chosen(total: Column) -> Column:
        first, second, third = (F.get(values, F.lit(i)) for i in range(3))
        plain = (F.size(values) >= 3) & (first > second) & (F.abs(first - second - third) < 0.02) & (total.isNull() | (F.abs(total - third) < 0.02))
        return F.when(F.coalesce(plain, F.lit(False)), third).otherwise(F.coalesce(total, under("amount_to_be_paid")))

    return F.when(F.size(values) > 0, once(under("total_invoice_amount"), chosen))


def before_discount(value: Column, gross: Column, discount: Column) -> Column:
    """Whether an amount is the sum before a known discount."""
    return F.coalesce((discount > 0) & (F.abs(value - gross) < 0.02), F.lit(False))


def invoice_value(after_discount: Column, labelled: Column, amount_field: Column, amount_text: Column, header: Column, line_sum: Column, gross: Column, discount: Column) -> tuple[Column, Column]:
    """(value, step 1 to 7): the sum after discount, a labelled total, the amount field, the amount in the text, the header against the lines' sum, the header, the lines' sum; 0 and null without any.

    Sums before a discount don't count, nor does an amount field that is a tenth of the lines' sum, or the header, at most: a piece of it.
    """
    reference = F.coalesce(line_sum, header, F.lit(0.0))
    torn = (reference > 0) & (amount_field < reference * 0.9) & (reference >= amount_field * 10)
    fits = lambda x: _positive(x) & ~before_discount(x, gross, discount)
    both = fits(header) & _positive(line_sum)
    larger, smaller = F.greatest(header, line_sum), F.least(header, line_sum)
    agreed = F.when(larger > smaller * DIVERGENCE, smaller).otherwise(header)
    steps = [(_positive(after_discount), after_discount), (fits(labelled), labelled), (fits(amount_field) & ~F.coalesce(torn, F.lit(False)), amount_field), (fits(amount_text), amount_text), (both, agreed), (fits(header), header), (_positive(line_sum), line_sum)]
    value, step = F.lit(0.0), F.lit(None).cast("int")
    for i, (when, what) in reversed(list(enumerate(steps, 1))):
        value, step = F.when(when, round_money(what)).otherwise(value), F.when(when, i).otherwise(step)
    return value, step


def style_block(text: Column, style: Column, lines: int = 6) -> tuple[Column, Column]:
    """(code, country) in the first line that holds a style and the five below it; null where they aren't there."""
    split = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    at = F.array_position(F.transform(split, lambda x: F.upper(x).contains(F.upper(style))), F.lit(True))
    block = F.when(at > 0, F.array_join(F.slice(split, at.cast("int"), F.lit(lines)), "\n"))
    raw, country = F.regexp_extract(block, BLOCK_CODE, 1), F.trim(F.regexp_extract(block, BLOCK_ORIGIN, 1))
    return F.when(raw != "", normalise(raw)[0]), F.when(country != "", country)


#: A row that starts with a quantity and a style, with amounts behind; code and origin in a style's block.  Fixed values.
STYLE_ROW = r"(?i)^\s*(\d{1,5})\s+([12][A-Z]{2}[A-Z0-9]{8,})\s+([\d.,]+)"
BLOCK_CODE, BLOCK_ORIGIN = r"(?i)\bHS\s*Code\s*[-–]\s*([\d][\d.\s]{5,16}\d)\b", r"(?i)\bOrigin\s*[-–]\s*([A-Za-z]+(?:[ \t]+[A-Za-z]+)*)"


def style_rows(docs: DataFrame) -> DataFrame:
    """(id, ord, quantity, style, line_total, unit_price) of the rows of a text (id, text) that start with a quantity and a style; headings and totals are no rows.

    The first amount behind the style is the line's total; the last of two or more is the price.
    """
    rows = docs.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("ord", "line"))
    line = F.trim("line")
    rows = rows.where((line != "") & ~line.rlike(r"(?i)^(?:Style|Style\s+Description|Total|Subtotal|Payment|Due)\b"))
    quantity, style, total = F.regexp_extract(line, STYLE_ROW, 1).try_cast("double"), F.upper(F.regexp_extract(line, STYLE_ROW, 2)), parse_locale_number(F.regexp_extract(line, STYLE_ROW, 3))
    behind = F.filter(F.transform(F.regexp_extract_all(F.call_function("substring_index", F.upper(line), style, F.lit(-1)), F.lit(r"([\d.,]*\d)"), 1), parse_locale_number), lambda x: x > 0)
    out = rows.select("id", "ord", quantity.alias("quantity"), style.alias("style"), total.alias("line_total"), behind.alias("_behind")).where("quantity > 0 AND line_total > 0")
    return out.withColumn("unit_price", F.when(F.size("_behind") >= 2, F.element_at("_behind", -1)).otherwise(F.col("line_total") / F.col("quantity"))).drop("_behind")


def description_source(sources: Column) -> Column:
    """The source of an aggregate's description: the common one, else the first of DESCRIPTION_SOURCES that is there; rule_based of none."""
    one = F.when(F.size(F.array_distinct(sources)) == 1, F.get(sources, F.lit(0)))
    return F.coalesce(one, *(F.when(F.array_contains(sources, s), s) for s in DESCRIPTION_SOURCES), F.lit("rule_based"))


def source_counts(*tables: DataFrame) -> DataFrame:
    """(description_source, rows) over the rows of all tables."""
    out = tables[0].select("description_source")
    for t in tables[1:]:
        out = out.unionByName(t.select("description_source"))
    return out.groupBy("description_source").agg(F.count("*").alias("rows"))


def joined_descriptions(descriptions: Column) -> Column:
    """The distinct trimmed descriptions of an array, in order, joined by a comma."""
    trimmed = F.filter(F.transform(descriptions, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(trimmed), ", ")


def rebuilt_origins(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregates (keys, source_positions, countries) with the countries of all their lines (keys, position, country), sorted; and as one text."""
    named = rows.select(*keys, F.explode("source_positions").alias("position")).join(lines.where("country != ''").select(*keys, "position", "country"), [*keys, "position"])
    found = named.groupBy(*keys).agg(F.collect_set("country").alias("_more"))
    both = F.array_sort(F.filter(F.array_union("countries", F.coalesce("_more", F.array().cast("array<string>"))), lambda c: c.isNotNull() & (c != "")))
    return rows.join(found, keys, "left").withColumn("countries", both).drop("_more").withColumn("country", F.array_join("countries", ", "))


def item_at(wanted: DataFrame, items: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Left join of (key, position) with items (key, position, ord, value): by position, else by ordinal; ``how`` tells which."""
    by_position = items.where("position IS NOT NULL").groupBy(key, "position").agg(F.min_by("value", "ord").alias("_a"))
    by_ordinal = items.select(key, F.col("ord").alias("position"), F.col("value").alias("_b"))
    both = wanted.join(by_position, [key, "position"], "left").join(by_ordinal, [key, "position"], "left")
    return both.withColumns({"value": F.coalesce("_a", "_b"), "how": F.when(F.col("_a").isNotNull(), "position").when(F.col("_b").isNotNull(), "ordinal").otherwise("none")}).drop("_a", "_b")


def excluded_lines(lines: DataFrame, excluded: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Lines (key, style, preference) with NO where (key, style) is on the exclusion list: a join, so that a list may be of any length."""
    marked = excluded.select(key, "style").distinct().withColumn("_out", F.lit(True))
    return lines.join(marked, [key, "style"], "left").withColumn("preference", F.when(F.col("_out"), "NO").otherwise(F.col("preference"))).drop("_out")


def in_range(latitude: Column, longitude: Column, *amounts_: Column) -> Column:
    """Whether a request's place (which may be null) and amounts are possible."""
    out = F.coalesce(latitude.between(-90, 90), F.lit(True)) & F.coalesce(longitude.between(-180, 180), F.lit(True))
    for x in amounts_:
        out = out & F.coalesce(x >= 0, F.lit(False))
    return out
