"""Tariff codes in the text of documents: hits by kind of place, what is no code, the best hit of a key, the code of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.tariff import normalise
from customsloom.functions.text import is_complete_vehicle

#: Places of codes in a text: a labelled code, a dotted one, a table row, a row that starts with its position.  Fixed values.
LABELLED = r"(?i)\b(?:HS(?:\s+code)?|TARIC|CN(?:\s+code)?|Commodity(?:\s*code)?|Customs\s+Tariff|Nomenclature|Tariff(?:\s*code)?)\s*[:\-]?\s*([\d][\d.\s]{5,16}\d)\b"
DOTTED = r"\b(\d{4}[.\s]\d{2}[.\s]\d{2})\b"
TABLE_ROW = r"(?m)^\s*(\d{1,3})\s+(\d{8,12})\s+[A-Za-z]\s+"
POSITION_ROW = r"(?i)^\s*(?:pos(?:ition)?\s*)?(\d{1,3})\b.*?\b(\d{4}[.\s]?\d{2}[.\s]?\d{2}|\d{8,10})\b"
MIXED = r"\b([0-9][0-9A-Za-z]{5,11})\b"
#: What stands before a number that is no code.  Fixed values.
NO_CODE_BEFORE = r"(?i)(?:\binvoice\s*(?:no|number)?\s*[:\-]?\s*$|\b(?:tel|phone|fax|vat|eori|iban)\b|\b(?:art(?:icle)?|sku|barcode|ean|gtin|product)\s*(?:no|number|code)?\s*[:\-]?\s*$|\d{1,2}[./]\d{1,2}[./]$)"
CONFIDENCE = {"table": 0.97, "labelled": 0.92, "dotted": 0.90, "position": 0.85, "bare": 0.70}
REPAIRED_AT_MOST = 0.88
#: Headings of vehicles and of their parts, and what they add or take; what a line's own code adds.  Fixed values.
VEHICLE, PART, VEHICLE_ADDS, PART_TAKES, LINE_ADDS = ["8701", "8702", "8703", "8704", "8705"], ["8708", "8409", "8483", "8707"], 0.12, 0.65, 0.08


def is_barcode(digits: Column) -> Column:
    return digits.rlike(r"^88\d{6,7}$")


def no_code(token: Column, before: Column) -> Column:
    """Whether a number of eight to ten digits after these characters is a date, a phone number, an article number and the like."""
    code, _, _ = normalise(token)
    return before.rlike(NO_CODE_BEFORE) | code.isNull() | code.rlike(r"^20[0-9]{6}$") | is_barcode(code)


def _pairs(text: Column, pattern: str, kind: str, position: int | None, code: int) -> Column:
    codes = F.regexp_extract_all(text, F.lit(pattern), code)
    places = F.regexp_extract_all(text, F.lit(pattern), position) if position else F.transform(codes, lambda _: F.lit(None).cast("string"))
    return F.transform(F.arrays_zip(places.alias("p"), codes.alias("c")), lambda x: F.struct(x["p"].cast("int").alias("position"), x["c"].alias("raw"), F.lit(kind).alias("source"), F.lit(CONFIDENCE[kind]).alias("confidence")))


def hits(docs: DataFrame, strict: bool = False) -> DataFrame:
    """(id, position, code, source, confidence): for each code of a text (id, text), and position if it has one, the surest hit.

    Unless ``strict``, words of 6 to 12 digits and letters read for digits count as bare codes wherever they stand, also those
    that ``no_code`` would leave out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, r"\r?\n")
    rows = F.flatten(F.transform(lines, lambda x: _pairs(x, POSITION_ROW, "position", 1, 2)))
    bare = F.regexp_extract_all(text, F.lit(r"\b(\d{8,10})\b"), 1)
    # what stands before each bare number: the text is cut at them
    parts = F.split(text, r"\b\d{8,10}\b")
    bare = F.transform(bare, lambda c, i: F.struct(F.lit(None).cast("int").alias("position"), F.when(~no_code(c, F.substring(F.get(parts, i), -12, 12)), c).alias("raw"), F.lit("bare").alias("source"), F.lit(CONFIDENCE["bare"]).alias("confidence")))
    mixed = _pairs(text, MIXED, "bare", None, 1)
    every = F.concat(_pairs(text, TABLE_ROW, "table", 1, 2), _pairs(text, LABELLED, "labelled", None, 1), _pairs(text, DOTTED, "dotted", None, 1), rows, bare, *([] if strict else [mixed]))
    each = docs.select("id", F.explode(every).alias("h")).select("id", "h.*").where("raw IS NOT NULL AND (position IS NULL OR position > 0)")
    code, invalid, repaired = normalise(F.col("raw"))
    each = each.select("id", "position", code.alias("code"), "source", F.when(repaired, F.least(F.col("confidence"), F.lit(REPAIRED_AT_MOST))).otherwise(F.col("confidence")).alias("confidence"), invalid.alias("invalid")).where("code IS NOT NULL AND NOT invalid")
    return best_hits(each.drop("invalid"))


def best_hits(rows: DataFrame) -> DataFrame:
    """Of each (id, position, code) the hit of greatest confidence; of equal ones the source that sorts first."""
    best = rows.groupBy("id", "position", "code").agg(F.max(F.struct("confidence", F.lit(0).alias("z"))).alias("m"), F.min_by("source", F.struct(-F.col("confidence"), F.col("source"))).alias("source"))
    return best.select("id", "position", "code", "source", F.col("m.confidence").alias("confidence"))


def document_code(found: DataFrame) -> DataFrame:
    """(id, code) of documents whose hits name one code only."""
    return found.groupBy("id").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).where("n = 1").select("id", "code")


def uniform_code(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """(id, code) of texts (id, text, lines) of two lines or more with a code that occurs for at least ``share`` of the lines, and twice; the first in the text."""
    numbers = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\b(\d{8,10})\b"), 1)
    each = docs.where("lines >= 2").select("id", "lines", F.posexplode(numbers).alias("at", "raw"))
    code, invalid, _ = normalise(F.col("raw"))
    counted = each.select("id", "lines", "at", code.alias("code"), invalid.alias("bad")).where("code IS NOT NULL AND NOT bad").groupBy("id", "lines", "code").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    enough = counted.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("lines") * share)))
    return enough.groupBy("id").agg(F.min_by("code", "at").alias("code"))


def forbidden_part(code: Column, description: Column) -> Column:
    """A part's heading for a complete vehicle."""
    return is_complete_vehicle(description) & F.substring(code, 1, 4).isin(PART)


def candidate_score(confidence: Column, code: Column, source: Column, description: Column) -> Column:
    whole, near = is_complete_vehicle(description), F.substring(code, 1, 4)
    return confidence + F.when(whole & near.isin(VEHICLE), VEHICLE_ADDS).otherwise(0.0) - F.when(whole & near.isin(PART), PART_TAKES).otherwise(0.0) + F.when(source == "invoice_line", LINE_ADDS).otherwise(0.0)


def line_candidates(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(id, position, code, source, confidence) of lines (id, position, invoice_code, code, final_code, wizard_code, by_user) and their documents' hits.

    Each code once, from the first that has it: the invoice's code, the line's, the final one, a suggested one, then hits of the
    line's position or of none.  Hits are left out in documents all of whose lines have a code.
    """
    own = F.array(
        F.struct(F.col("invoice_code").alias("raw"), F.lit("invoice_line").alias("source"), F.lit(0.98).alias("confidence"), F.lit(0).alias("ord")), F.struct(F.col("code").alias("raw"), F.lit("invoice_line").alias("source"), F.lit(0.96).alias("confidence"), F.lit(1).alias("ord")),
        F.struct(F.col("final_code").alias("raw"), F.lit("invoice_line").alias("source"), F.when(F.col("by_user"), 0.99).otherwise(0.94).alias("confidence"), F.lit(2).alias("ord")), F.struct(F.col("wizard_code").alias("raw"), F.lit("wizard").alias("source"), F.lit(0.90).alias("confidence"), F.lit(3).alias("ord")),
    )
    named = lines.select("id", "position", F.inline(own))
    bare = lines.groupBy("id").agg(F.min(normalise(F.col("code"))[0].isNotNull()).alias("all_coded")).where("NOT all_coded").select("id")
    at = lines.join(bare, "id").select("id", "position").distinct()
    source = F.when(F.col("confidence") >= 0.9, "position_match").otherwise("corpus_regex")
    swept = at.join(found.withColumnRenamed("position", "place"), "id").where("place IS NULL OR place = position").select("id", "position", F.col("code").alias("raw"), source.alias("source"), "confidence", F.lit(4).alias("ord"))
    code, invalid, _ = normalise(F.col("raw"))
    every = named.unionByName(swept).select("id", "position", code.alias("code"), "source", "confidence", "ord", invalid.alias("bad")).where("code IS NOT NULL AND NOT bad").where(~is_barcode(F.col("code")))
    first = every.groupBy("id", "position", "code").agg(F.min_by(F.struct("source", "confidence", "ord"), F.struct(F.col("ord"), -F.col("confidence"))).alias("f"))
    return first.select("id", "position", "code", "f.source", "f.confidence", "f.ord")


def best_candidates(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, position, code, score) of each line's best candidate that isn't a part of a complete vehicle; earlier ones win ties."""
    both = candidates.join(lines.select("id", "position", "description"), ["id", "position"]).where(~forbidden_part(F.col("code"), F.col("description")))
    scored = both.withColumn("score", F.round(candidate_score(F.col("confidence"), F.col("code"), F.col("source"), F.col("description")), 6))
    rank = F.row_number().over(Window.partitionBy("id", "position").orderBy(F.desc("score"), "ord", "code"))
    return scored.withColumn("_k", rank).where("_k = 1").select("id", "position", "code", "score")
