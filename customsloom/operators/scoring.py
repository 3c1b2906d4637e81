"""Scores and verdicts over invoices: completeness, confidence, readiness, weighted dimensions, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.country import in_eu
from customsloom.functions.numbers import round_up
from customsloom.functions.text import squeezed

#: Weights of what a line should have, and of the dimensions of the two scores.  Fixed values.
LINE_WEIGHTS = {"description": 0.25, "hs_code": 0.25, "country": 0.15, "line_total": 0.15, "quantity": 0.1, "unit_price": 0.1}
READINESS_WEIGHTS = {"gross_weight": 15, "package_count": 15, "package_type": 10, "incoterms": 15, "vat_article": 10, "origin_evidence": 20, "declaration": 15}
EXTRACTION_WEIGHTS = {"ocr": 20, "line": 20, "hs": 20, "coo": 15, "value": 15, "origin": 10}
#: Points that issues cost.  Fixed values.
CRITICAL_ERROR, CRITICAL_WARNING, MINOR = 18, 12, 3
SEVERITY = {"error": 3, "warning": 2, "info": 1}


def rounded(x: Column) -> Column:
    return round_up(x, 0).cast("int")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of scores by name, rounded."""
    total = float(sum(weights[k] for k in scores))
    out = F.lit(0.0)
    for name, score in scores.items():
        out = out + score * float(weights[name])
    return rounded(out / total)


def weakest(scores: dict[str, Column]) -> Column:
    """Name of the lowest score, the first in order of equal ones."""
    ranked = [F.struct(score.cast("double").alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, score) in enumerate(scores.items())]
    return F.array_min(F.array(*ranked))["name"]


def item_metrics(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Per invoice the number of lines and of those with each thing of LINE_WEIGHTS that the table has."""
    there = {n: F.col(n).isNotNull() & (F.trim(F.col(n).cast("string")) != "") for n in LINE_WEIGHTS if n in lines.columns}
    return lines.groupBy(key).agg(F.count("*").alias("items"), *(F.count_if(c).alias(f"with_{n}") for n, c in there.items()))


def line_score(items: Column, **counts: Column) -> Column:
    out = F.lit(0.0)
    for name, n in counts.items():
        out = out + n / items * LINE_WEIGHTS[name]
    return F.when(items > 0, rounded(out * 100)).otherwise(0)


def completeness(header: Column, lines: Column, items: Column, foundation: Column, mismatch: Column) -> Column:
    """0.6 header and 0.4 lines; at most 70 without the foundation or lines, at most 60 if totals don't match."""
    score = F.when(items == 0, header).otherwise(rounded(header * 0.6 + lines * 0.4))
    score = F.when(~foundation | (items == 0), F.least(score, F.lit(70))).otherwise(score)
    return F.when(mismatch, F.least(score, F.lit(60))).otherwise(score).cast("int")


def penalty(kind: Column, critical: Column) -> Column:
    return F.when(critical & (kind == "error"), CRITICAL_ERROR).when(critical & (kind == "warning"), CRITICAL_WARNING).when(kind == "error", CRITICAL_ERROR).when(kind == "warning", MINOR).otherwise(0)


def readiness(issues: DataFrame, invoices: DataFrame, key: str = "invoice_id", base: float = 100.0) -> DataFrame:
    """Base score less the penalty of each distinct issue code of an invoice, between 0 and 100.

    ``issues`` has the key, code, kind and critical; ``invoices`` has the key.
    """
    costs = issues.groupBy(key, "code").agg(F.max(penalty(F.col("kind"), F.col("critical"))).alias("cost")).groupBy(key).agg(F.sum("cost").alias("costs"))
    return invoices.select(key).join(costs, key, "left").select(key, rounded(clamp(base - F.coalesce("costs", F.lit(0)))).alias("readiness_score"))


def verdict(blocked: Column, reasons: Column) -> Column:
    """CUSTOMS_BLOCKED if there is a blocking reason, CUSTOMS_REVIEW if there is another, else CUSTOMS_READY; of two arrays."""
    return F.when(F.size(F.array_compact(blocked)) > 0, "CUSTOMS_BLOCKED").when(F.size(F.array_compact(reasons)) > 0, "CUSTOMS_REVIEW").otherwise("CUSTOMS_READY")


def export_status(score: Column, errors: Column, goods: Column, codes: Column, blocking: Column) -> Column:
    return F.when((errors > 0) | blocking | (score < 80), "Needs Review").when((goods > 0) & (codes == 0), "Ready With Review").when(score >= 90, "Ready").otherwise("Ready With Review")


def confidence(source_penalty: Column, missing: Column, no_codes: Column, no_origin: Column, mismatch: Column, complete: Column) -> Column:
    """100 less penalties of sources, missing fields, lines without codes (10) or origin (5) and unequal totals (15); 99 at most unless complete."""
    score = 100 - source_penalty - missing - F.when(no_codes, 10).otherwise(0) - F.when(no_origin, 5).otherwise(0) - F.when(mismatch, 15).otherwise(0)
    return rounded(F.greatest(F.lit(0), F.when(complete, score).otherwise(F.least(score, F.lit(99)))).cast("double"))


def dedupe_issues(issues: DataFrame, key: str = "invoice_id") -> DataFrame:
    """One issue a code: the most severe, then one with a field, then the longest message, then the first."""
    rank = F.when(F.col("kind") == "error", 3).when(F.col("kind") == "warning", 2).otherwise(1)
    order = Window.partitionBy(key, "code").orderBy(rank.desc(), F.col("field").isNull(), F.length("message").desc(), "ord")
    return issues.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def severity_counts(issues: DataFrame, *keys: str) -> DataFrame:
    return issues.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("error", "critical"), ("warning", "warnings"), ("info", "infos"))))


def packages(colli: Column, pallets: Column, kind: Column) -> tuple[Column, Column, Column]:
    """(count, type, needs review) for the declaration from cartons, pallets and the stated type."""
    has_colli, has_pallets, cartons = F.coalesce(colli > 0, F.lit(False)), F.coalesce(pallets > 0, F.lit(False)), F.upper(F.trim(kind)).eqNullSafe("CT")
    both = has_colli & has_pallets
    count = F.when(both & cartons, colli).when(has_pallets, pallets).when(has_colli, colli)
    name = F.when(both & cartons, "CT").when(has_pallets, "PAL").when(has_colli & cartons, "CT").when(has_colli, "COLLI")
    return count, name, both & ~cartons


def weight_findings(net: Column, gross: Column, documented: Column, line_net: Column) -> Column:
    """NET_EXCEEDS_GROSS where both come from documents, UNIT_WEIGHT_MISUSE where line weights pass 1.1 times gross; an array."""
    return F.array_compact(F.array(F.when((gross > 0) & (net > gross) & documented, "NET_EXCEEDS_GROSS"), F.when((gross > 0) & (line_net > gross * 1.1), "UNIT_WEIGHT_MISUSE")))


def missing_fields(**fields: Column) -> Column:
    """Names of the fields that are null, blank or a dash; an array."""
    empty = lambda c: c.isNull() | F.trim(c.cast("string")).isin("", "—")
    return F.array_compact(F.array(*(F.when(empty(c), n) for n, c in fields.items())))


def cargo_fit(length_cm: Column, width_cm: Column, height_cm: Column) -> Column:
    """fits, restricted (too high) or special_transport (too long or wide) in a standard trailer."""
    return F.when((width_cm > 245) | (length_cm > 1360), "special_transport").when(height_cm > 270, "restricted").otherwise("fits")


#: Codes of issues by severity, and what in a message gives an issue its code, in order.  Fixed values.
CRITICAL_CODES = [
    "MISSING_EXPORTER", "MISSING_CONSIGNEE", "MISSING_INVOICE_NUMBER", "MISSING_INVOICE_VALUE", "MISSING_DESTINATION", "MISSING_DESTINATION_COUNTRY", "EU_DESTINATION", "PARSER_MAPPING_FAILURE", "INVOICE_DATE_IN_FUTURE",
    "INCONSISTENT_TOTALS", "INCONSISTENT_INVOICE_TOTAL", "TOTAL_MISMATCH", "HS_AGGREGATION_MISSING", "TRACEABILITY_MISSING", "EXTRACTION_INTEGRITY_ERROR", "INVALID_HS_FORMAT", "HS_EXTRACTION_FAILURE",
    "INCONSISTENT_LINE_TOTALS", "POSITION_DATA_OVERWRITE_CORRUPTION", "POSITION_QTY_MISMATCH", "POSITION_UNIT_PRICE_MISMATCH", "POSITION_VALUE_MISMATCH",
]
WARNING_CODES = [
    "MISSING_HS_CODE", "NO_HS_CODE", "NO_HS_CODES", "NO_HS_CODES_DETECTED", "HS_CODE_NOT_ON_INVOICE", "UNKNOWN_HS_CODE", "MISSING_GROSS_WEIGHT", "MISSING_PACKAGE_COUNT", "MISSING_INCOTERMS", "NO_INCOTERMS",
    "TOTAL_VALUE_PARSING_ERROR", "MULTIPLE_HS_CANDIDATES_DETECTED", "EXTRACTION_LINE_COUNT_MISMATCH", "DUPLICATE_LINE_EXTRACTION", "DUPLICATE_POSITION_NUMBER_ON_INVOICE", "MISSING_POSITION_NUMBER_ON_INVOICE",
    "POSITION_SEQUENCE_GAP", "POSITION_SEQUENCE_DUPLICATE", "MISSING_NET_WEIGHT",
]
INFO_CODES = ["NO_ORIGIN_DECLARATION", "ORIGIN_DECLARATION_MISSING", "ORIGIN_DECLARATION_NOT_FOUND", "ORIGIN_DECLARATION_REQUIRED", "MISSING_ORIGIN_DECLARATION", "LTSD_REFERENCED", "PROFORMA_DETECTED", "DELIVERY_NOTE_DETECTED"]
MESSAGE_CODES = [
    (r"vat\s+(?:legal\s+)?article|missing\s+vat\s+article", "MISSING_VAT_ARTICLE"),
    ("net weight not found|missing net weight|net shipment weight is missing", "MISSING_NET_WEIGHT"),
    ("missing hs|no hs code|hs code.*missing|hs codes not present", "MISSING_HS_CODE"),
    ("country of origin.*missing|missing.*country of origin|no country of origin", "MISSING_COUNTRY_OF_ORIGIN"),
    ("destination.*missing|missing.*destination", "MISSING_DESTINATION"),
    ("invoice value.*missing|missing.*invoice value", "MISSING_INVOICE_VALUE"),
    ("invoice total differs significantly|total_value_parsing_error", "TOTAL_VALUE_PARSING_ERROR"),
    ("total mismatch|total differs by more than 1%", "TOTAL_MISMATCH"),
    ("hs codes detected on invoice but aggregation", "HS_AGGREGATION_MISSING"),
    ("line items extracted but position traceability", "TRACEABILITY_MISSING"),
    ("line item count differs from position rows|extraction_line_count_mismatch", "EXTRACTION_LINE_COUNT_MISMATCH"),
    ("duplicate commercial line|duplicate_line_extraction", "DUPLICATE_LINE_EXTRACTION"),
    ("position.*overwrite|position_data_overwrite", "POSITION_DATA_OVERWRITE_CORRUPTION"),
    ("duplicate position number on invoice|duplicate_position_number_on_invoice", "DUPLICATE_POSITION_NUMBER_ON_INVOICE"),
    ("missing position number on invoice|missing_position_number_on_invoice", "MISSING_POSITION_NUMBER_ON_INVOICE"),
    ("position sequence gap|position_sequence_gap", "POSITION_SEQUENCE_GAP"),
    ("position sequence duplicate|position_sequence_duplicate", "POSITION_SEQUENCE_DUPLICATE"),
    ("position.*qty mismatch|position_qty_mismatch", "POSITION_QTY_MISMATCH"),
    ("unit price mismatch|position_unit_price_mismatch", "POSITION_UNIT_PRICE_MISMATCH"),
    ("position.*value mismatch|position_value_mismatch", "POSITION_VALUE_MISMATCH"),
    ("duplicate position number|duplicate_position_number", "DUPLICATE_POSITION_NUMBER"),
    ("missing position number|missing_position_number", "MISSING_POSITION_NUMBER"),
    ("position sequence break|position_sequence_break", "POSITION_SEQUENCE_BREAK"),
    ("aggregation traceability|aggregation_traceability", "AGGREGATION_TRACEABILITY_FAILURE"),
    ("authorization country prefix differs|authorization_country_mismatch", "AUTHORIZATION_COUNTRY_MISMATCH"),
    (r"hs/tariff codes are visible|hs_extraction_failure", "HS_EXTRACTION_FAILURE"),
    ("invalid hs code", "INVALID_HS_FORMAT"),
]
#: Score that a document ready in all respects doesn't fall below but by minor issues; the same where only codes await classification; what a missing exporter's authorisation costs.  Fixed values.
COMPLETE_FLOOR, CLASSIFICATION_FLOOR, UNAUTHORISED = 95, 90, 8
#: Issues that keep a document out of the set of good ones.  Fixed values.
GOLDEN_BLOCKS = [
    "POSITION_FINGERPRINT_COLLISION", "HS_STYLE_MISMATCH", "COO_STYLE_MISMATCH", "DESCRIPTION_ARTIFACT", "EXTRACTION_LINE_COUNT_MISMATCH", "POSITION_QTY_MISMATCH", "POSITION_UNIT_PRICE_MISMATCH", "POSITION_VALUE_MISMATCH",
    "POSITION_DATA_OVERWRITE_CORRUPTION", "DUPLICATE_POSITION_NUMBER", "MISSING_POSITION_NUMBER", "POSITION_SEQUENCE_BREAK", "AGGREGATION_TRACEABILITY_FAILURE",
]


def issue_code(code: Column, message: Column) -> Column:
    """An issue's code, or what its message tells; null if neither does."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(MESSAGE_CODES):
        out = F.when(message.rlike(f"(?i){pattern}"), name).otherwise(out)
    return F.coalesce(F.when(F.trim(code) != "", code), out)


def issue_severity(code: Column, kind: Column) -> Column:
    """CRITICAL, WARNING or INFO by code, else by kind."""
    known = lambda codes: F.coalesce(code.isin(codes), F.lit(False))
    return F.when(known(CRITICAL_CODES), "CRITICAL").when(known(WARNING_CODES), "WARNING").when(known(INFO_CODES) | (kind == "info"), "INFO").when(kind == "error", "CRITICAL").when(kind == "warning", "WARNING").otherwise("INFO")


def adjusted_readiness(issues: DataFrame, documents: DataFrame, key: str = "invoice_id", base: float = 100.0) -> DataFrame:
    """Readiness with its floors, from issues (key, code, kind, critical) and documents (key, declared, eur1, authorised, codes, export_ready, confirmed, foundation, only_classification).

    The penalty of each distinct code, 8 points for a declaration with an advised EUR.1 without authorisation; a document without a critical issue that has codes, is ready for export and
    of confirmed origin keeps 95 less its minor penalties, one of whom only codes await classification 90.  Between 0 and 100.
    """
    blocker = F.col("critical") & F.col("kind").isin("error", "warning")
    each = issues.groupBy(key, "code").agg(F.max(penalty(F.col("kind"), F.col("critical"))).alias("cost"))
    costs = each.groupBy(key).agg(F.sum("cost").alias("_costs"))
    minor = issues.groupBy(key).agg(F.max(blocker).alias("_blocked"), F.sum(F.when(~blocker & (F.col("kind") != "info"), penalty(F.col("kind"), F.col("critical"))).otherwise(0)).alias("_minor"))
    rows = documents.join(costs, key, "left").join(minor, key, "left").fillna(0, ["_costs", "_minor"]).withColumn("_blocked", F.coalesce("_blocked", F.lit(False)))
    score = base - F.col("_costs") - F.when(F.col("declared") & F.col("eur1") & ~F.col("authorised"), UNAUTHORISED).otherwise(0)
    whole = ~F.col("_blocked") & (F.col("codes") > 0) & F.col("export_ready") & F.col("confirmed")
    score = F.when(whole, F.greatest(score, COMPLETE_FLOOR - F.col("_minor"))).otherwise(score)
    waiting = F.col("foundation") & (F.col("codes") == 0) & F.col("only_classification")
    score = F.when(waiting, F.greatest(score, F.lit(float(CLASSIFICATION_FLOOR)))).otherwise(score)
    return rows.select(key, rounded(clamp(score)).alias("readiness_score"))


def without_resolved(issues: DataFrame, resolved: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Issues (key, code) but those that a document's state resolves (key, code)."""
    return issues.join(resolved.select(key, "code").distinct(), [key, "code"], "left_anti")


#: What a document's state resolves, in the order in which it is looked at: condition, codes, and messages of issues with other codes.  Fixed values.
RESOLUTIONS = [
    (
        "origin_declared",
        ["NO_ORIGIN_DECLARATION", "ORIGIN_DECLARATION_MISSING", "ORIGIN_DECLARATION_NOT_FOUND", "ORIGIN_DECLARATION_REQUIRED", "MISSING_ORIGIN_DECLARATION", "MISSING_COUNTRY_OF_ORIGIN", "NO_COUNTRY_OF_ORIGIN"],
        "no preferential origin declaration|no origin declaration|origin declaration not found|origin declaration missing|origin declaration required|missing.*country of origin|no country of origin|country of origin.*missing",
    ),
    ("outside_union", ["EU_DESTINATION"], "within the eu customs territory"),
    (
        "no_shipment_data",
        ["MISSING_GROSS_WEIGHT", "MISSING_PACKAGE_COUNT", "MISSING_NET_WEIGHT"],
        "missing gross weight|gross shipment weight is missing|missing package count|package count is missing|missing net weight|net weight not found",
    ),
    ("gross_known", ["MISSING_GROSS_WEIGHT"], "missing gross weight|gross shipment weight is missing"),
    ("net_known", ["MISSING_NET_WEIGHT"], "missing net weight|net shipment weight is missing"),
    ("packages_known", ["MISSING_PACKAGE_COUNT"], "missing package count|package count is missing"),
    ("codes_known", ["MISSING_HS_CODE", "NO_HS_CODE", "NO_HS_CODES", "NO_HS_CODES_DETECTED"], "no hs code|missing hs|hs code.*missing|hs codes not present|hs codes not detected"),
    ("countries_known", ["MISSING_COUNTRY_OF_ORIGIN", "NO_COUNTRY_OF_ORIGIN"], "missing.*country of origin|country of origin.*missing|no country of origin"),
    ("vat_article", ["MISSING_VAT_ARTICLE"], None),
]


def root_code(field: Column, message: Column) -> Column:
    """An issue's code: its field in capitals, else what its message tells, else the first word in capitals of the message, else the message in small letters."""
    word = F.regexp_extract(message, r"\b([A-Z][A-Z0-9_]{2,})\b", 1)
    return F.coalesce(issue_code(F.upper(F.trim(field)), message), F.when(word != "", word), squeezed(message))


def resolutions(origin_declared: Column, destination: Column, gross: Column, net: Column, cartons: Column, pallets: Column, package_type: Column, codes: Column, countries: Column, shipment_data: Column, vat_article: Column) -> Column:
    """Names of the RESOLUTIONS that a document's state meets, in order; an array.

    codes and countries are numbers of codes and of countries of origin found, shipment_data whether any source held data of the shipment (null: it did).  Nulls are unknown, and an
    unknown destination lies outside of the Union.
    """
    known = {
        "origin_declared": origin_declared, "outside_union": ~F.coalesce(in_eu(F.upper(F.trim(destination))), F.lit(False)), "no_shipment_data": ~F.coalesce(shipment_data, F.lit(True)), "gross_known": gross > 0, "net_known": net.isNotNull(),
        "packages_known": packages(cartons, pallets, package_type)[0].isNotNull(), "codes_known": codes > 0, "countries_known": countries > 0, "vat_article": vat_article,
    }
    return F.array_compact(F.array(*(F.when(known[name], name) for name, *_ in RESOLUTIONS)))


def with_resolution(issues: DataFrame, states: DataFrame, key: str = "invoice_id") -> DataFrame:
    """All issues (key, field, message and others) with code and resolved_by, the first condition of their document's state that settles them.

    ``states`` has the key, once each, and the array ``resolved``; resolved_by is null where nothing settles an issue or its document isn't there.  Issues with a null
    message go by their field.  The rest of them is what counts: ``where("resolved_by IS NULL")``.
    """
    rows = issues.withColumn("code", root_code(F.col("field"), F.col("message"))).join(states.select(key, F.col("resolved").alias("_resolved")), key, "left")
    first = F.lit(None).cast("string")
    for name, codes, message in reversed(RESOLUTIONS):
        settles = F.col("code").isin(codes)
        if message is not None:
            settles = F.coalesce(settles, F.lit(False)) | F.coalesce(F.col("message").rlike(f"(?i){message}"), F.lit(False))
        first = F.when(settles & F.array_contains("_resolved", name), name).otherwise(first)
    return rows.withColumn("resolved_by", first).drop("_resolved")


def top_reasons(own: Column, issue_messages: Column, missing: Column, limit: int = 3) -> Column:
    """The first reasons: the verdict's own, else the distinct messages of issues, else the first missing field; arrays."""
    filled = F.filter(own, lambda x: (F.trim(x) != "") & (x != "Required declaration data available"))
    messages = F.array_distinct(F.filter(F.transform(issue_messages, lambda x: F.trim(x)), lambda x: x != ""))
    first = F.slice(F.transform(F.filter(missing, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("Missing: "), F.trim(x))), 1, 1)
    return F.when(F.size(filled) > 0, F.slice(filled, 1, limit)).when(F.size(messages) > 0, F.slice(messages, 1, limit)).otherwise(first)


def golden_gate(lines: DataFrame, issues: DataFrame, documents: DataFrame, key: str = "invoice_id") -> DataFrame:
    """(key, failures) of documents (key, source_lines): sorted codes of what keeps them out of the set of good ones; lines have quantity and line_total."""
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    own = lines.groupBy(key).agg(F.count("*").alias("_lines"), F.max(~positive("quantity") & positive("line_total")).alias("_q"), F.max(positive("quantity") & ~positive("line_total")).alias("_v"))
    blocks = issues.where(F.col("code").isin(GOLDEN_BLOCKS)).groupBy(key).agg(F.collect_set("code").alias("_codes"))
    rows = documents.join(own, key, "left").join(blocks, key, "left")
    differs = (F.col("source_lines") > 0) & (F.coalesce("_lines", F.lit(0)) != F.col("source_lines"))
    found = F.array_compact(F.array(F.when(F.col("_q"), "ZERO_QTY_WITH_VALUE"), F.when(F.col("_v"), "ZERO_VALUE_WITH_QTY"), F.when(differs, "EXTRACTION_LINE_COUNT_MISMATCH")))
    return rows.select(key, F.array_sort(F.array_distinct(F.concat(found, F.coalesce("_codes", F.array().cast("array<string>"))))).alias("failures"))


def surfaces(key: str, **tables: DataFrame) -> DataFrame:
    """(key, field, shown, names): fields that surfaces (each key, field, value) show in different ways, with all values and the surfaces in order of name."""
    every = None
    for name in sorted(tables):
        part = tables[name].select(key, "field", F.col("value").cast("string").alias("value"), F.lit(name).alias("surface")).where("value IS NOT NULL")
        every = part if every is None else every.unionByName(part)
    both = every.groupBy(key, "field").agg(F.count_distinct("value").alias("n"), F.array_sort(F.collect_list(F.struct("surface", "value"))).alias("all")).where("n > 1")
    return both.select(key, "field", F.array_join(F.transform("all", lambda x: x["value"]), "|").alias("shown"), F.array_join(F.transform("all", lambda x: x["surface"]), "|").alias("names"))


#: Issues that bear on a declaration, and what minor ones cost whatever their kind.  Fixed values.
CUSTOMS_CODES = [
    "MISSING_GROSS_WEIGHT", "MISSING_NET_WEIGHT", "MISSING_PACKAGE_COUNT", "MISSING_INCOTERMS", "MISSING_VAT_ARTICLE", "NO_ORIGIN_DECLARATION", "MISSING_COUNTRY_OF_ORIGIN", "EU_DESTINATION", "MISSING_DESTINATION", "MISSING_DESTINATION_COUNTRY",
]
MINOR_PENALTIES = {
    "MISSING_VAT_ARTICLE": 5, "MISSING_NET_WEIGHT": 0, "NO_ORIGIN_DECLARATION": 0, "MISSING_COUNTRY_OF_ORIGIN": 0, "MISSING_DELIVERY_ADDRESS": 3, "INCOMPLETE_DELIVERY_ADDRESS": 3, "INVOICE_DATE_OLDER_THAN_180_DAYS": 10, "HS_CODE_NOT_ON_INVOICE": 5,
    "DELIVERY_NOTE_DETECTED": 0, "CERTIFICATE_OF_ORIGIN_REFERENCED": 0, "PACKING_LIST_REFERENCED": 0, "EUR1_REFERENCED": 0, "LTSD_REFERENCED": 0, "DESCRIPTION_REVIEW_RECOMMENDED": 0, "TOTAL_VALUE_PARSING_ERROR": 8,
}
FUTURE_DATE = 50
#: The most that a blocked and a reviewed document reach; labels from a score on.  Fixed values.
CAPS = {"CUSTOMS_BLOCKED": 45, "CUSTOMS_REVIEW": 85}
LABELS = [(90, "Ready for export declaration"), (75, "Mostly ready — review gaps"), (55, "Customs review required"), (0, "Significant gaps before filing")]


def code_penalty(code: Column, kind: Column, critical: Column) -> Column:
    """What an issue costs: minor codes their own, a date in the future 50, others by kind."""
    own = F.create_map(*(x for k, v in sorted(MINOR_PENALTIES.items()) for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(own, code), F.when(code == "INVOICE_DATE_IN_FUTURE", FUTURE_DATE), penalty(kind, critical))


def customs_dimensions(gross: Column, declared_packages: Column, packages_: Column, pallets: Column, package_type: Column, incoterms: Column, vat_article: Column, origin_status: Column, evidence: Column, declared: Column, missing: Column, ready: Column, export_ready: Column, codes: Column) -> dict[str, Column]:
    """The seven scores of a declaration, 0 to 100; ``codes`` are the codes of a document's issues (array), ``missing`` its number of missing fields (null: no verdict)."""
    has = lambda code: F.coalesce(F.array_contains(codes, code), F.lit(False))
    filled = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    present = F.when(F.coalesce(ready, F.lit(False)), 100.0).otherwise(clamp(rounded(F.greatest(F.lit(0), 10 - missing) / 10.0 * 100).cast("double")))
    return {
        "gross_weight": F.when(gross > 0, 100.0).when(has("MISSING_GROSS_WEIGHT"), 0.0).otherwise(40.0),
        "package_count": F.when(declared_packages > 0, 100.0).when(packages_ > 0, 90.0).when(pallets > 0, 75.0).when(has("MISSING_PACKAGE_COUNT"), 0.0).otherwise(30.0),
        "package_type": F.when(filled(package_type), 100.0).when(declared_packages.isNotNull(), 60.0).otherwise(35.0),
        "incoterms": F.when(filled(incoterms) & (F.trim(incoterms) != "—"), 100.0).when(has("MISSING_INCOTERMS"), 0.0).otherwise(25.0),
        "vat_article": F.when(filled(vat_article), 100.0).when(has("MISSING_VAT_ARTICLE"), 55.0).otherwise(70.0),
        "origin_evidence": F.when((origin_status == "CONFIRMED") | (evidence == "DECLARED"), 100.0).when(declared, 85.0).when(evidence == "UNVERIFIED", 45.0).when(origin_status == "NOT_DECLARED", 60.0).otherwise(50.0),
        "declaration": F.when(missing.isNull(), 50.0).when(F.coalesce(export_ready, F.lit(False)), present).otherwise(F.least(present, F.lit(75.0))),
    }


def customs_score(documents: DataFrame, issues: DataFrame, key: str = "invoice_id") -> DataFrame:
    """(key, customs_score, label) of documents (key, base, status), from issues (key, code, kind, critical).

    Each distinct code that bears on a declaration or is critical costs once (its dearest issue); a blocked document reaches 45, a reviewed
    one 85.  Nulls count for nothing."""
    counted = issues.where(F.col("code").isin(CUSTOMS_CODES) | F.coalesce("critical", F.lit(False)))
    each = counted.groupBy(key, "code").agg(F.max(code_penalty(F.col("code"), F.col("kind"), F.coalesce("critical", F.lit(False)))).alias("cost"))
    rows = documents.join(each.groupBy(key).agg(F.sum("cost").alias("_cost")), key, "left")
    score = F.col("base") - F.coalesce("_cost", F.lit(0))
    for status, most in CAPS.items():
        score = F.when(F.col("status") == status, F.least(score, F.lit(most))).otherwise(score)
    score = rounded(clamp(score.cast("double")))
    label = F.when(F.col("status") == "CUSTOMS_BLOCKED", "Not ready for filing")
    for least, name in LABELS:
        label = label.when(score >= least, name)
    return rows.select(key, score.alias("customs_score"), label.alias("label"))
