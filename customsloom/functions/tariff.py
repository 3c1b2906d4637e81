"""Tariff codes: normalising, repair, validation, prefixes, similarity, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Letters that text recognition puts for digits, and the digits.  Fixed values.
MISREAD, MEANT = "OoIilBbSs", "001118855"
#: Severity of a code's status, worst last.  Fixed values.
STATUS_RANK = {"VALID": 1, "REPAIRED": 2, "MISSING": 3, "UNKNOWN_HS": 4, "INVALID_FORMAT": 5}
CONFIDENCE = {"VALID": 100, "REPAIRED": 95, "UNKNOWN_HS": 60, "INVALID_FORMAT": 0, "MISSING": 0}


def of_map(key: Column, values: dict) -> Column:
    """A small dictionary as a CASE."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def digits(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"\D", "")


def strip_separators(code: Column) -> Column:
    return F.regexp_replace(F.trim(code), r"[\s.\-–—]+", "")


def normalise(code: Column) -> tuple[Column, Column, Column]:
    """(code of 6 to 12 digits or null, invalid, repaired)."""
    s = strip_separators(F.coalesce(code, F.lit("")))
    mended = F.translate(s, MISREAD, MEANT)
    good, mendable = s.rlike(r"^[0-9]{6,12}$"), mended.rlike(r"^[0-9]{6,12}$")
    return F.when(good, s).when(mendable, mended), ~good & ~mendable & s.rlike("[0-9A-Za-z]"), ~good & mendable


def cn8(code: Column) -> Column:
    """The first eight digits, null if there are fewer."""
    d = digits(code)
    return F.when(F.length(d) >= 8, F.substring(d, 1, 8))


def heading(code: Column) -> Column:
    return F.substring(digits(code), 1, 4)


def chapter(code: Column) -> Column:
    return F.substring(digits(code), 1, 2)


def display(code8: Column) -> Column:
    return F.concat_ws(" ", F.substring(code8, 1, 4), F.substring(code8, 5, 2), F.substring(code8, 7, 2))


def longest_prefix(rows: DataFrame, nomenclature: DataFrame, code_col: str, key_col: str = "cn_digits") -> DataFrame:
    """Adds match_level: taric10, cn8 or hs6, whichever longest prefix of the code the nomenclature has, else none."""
    out = rows
    for level, width in (("taric10", 10), ("cn8", 8), ("hs6", 6)):
        keys = nomenclature.where(F.length(key_col) >= width).select(F.substring(key_col, 1, width).alias(f"_{level}")).distinct()
        out = out.join(keys, (F.substring(code_col, 1, width) == F.col(f"_{level}")) & (F.length(code_col) >= width), "left")
    level = F.when(F.col("_taric10").isNotNull(), "taric10").when(F.col("_cn8").isNotNull(), "cn8").when(F.col("_hs6").isNotNull(), "hs6").otherwise("none")
    return out.withColumn("match_level", level).drop("_taric10", "_cn8", "_hs6")


def status(raw: Column, known: Column) -> Column:
    """VALID, REPAIRED, UNKNOWN_HS, INVALID_FORMAT or MISSING."""
    code, invalid, repaired = normalise(raw)
    return F.when(invalid, "INVALID_FORMAT").when(code.isNull(), "MISSING").when(~known, "UNKNOWN_HS").when(repaired, "REPAIRED").otherwise("VALID")


def worst_status(statuses: Column, mode: str = "reference") -> Column:
    """Of an array of statuses: the least severe in mode reference, the most severe in mode intended; MISSING of none."""
    pick = F.array_min if mode == "reference" else F.array_max
    ranks = F.transform(statuses, lambda s: of_map(s, STATUS_RANK))
    return F.coalesce(of_map(pick(ranks), {v: k for k, v in STATUS_RANK.items()}), F.lit("MISSING"))


def resolve_final(*candidates: Column) -> Column:
    """The first candidate that normalises to a code."""
    return F.coalesce(*(normalise(c)[0] for c in candidates))


def similarity(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length, in whole percent."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= F.least(F.length(a), F.length(b))) & (F.substring(a, 1, 12).substr(i, F.lit(1)) == b.substr(i, F.lit(1))), i).otherwise(n))
    return F.floor(same * 100.0 / F.greatest(F.length(a), F.length(b), F.lit(1)) + 0.5).cast("int")


def verification(invoice: Column, suggested: Column, confidence: Column, score: Column, confidence_at: int = 80, similarity_at: int = 95) -> Column:
    """Five-state verdict on an invoice's code beside a suggested one."""
    near = ((F.substring(invoice, 1, 2) == F.substring(suggested, 1, 2)) | (F.substring(invoice, 1, 6) == F.substring(suggested, 1, 6))) & (score >= similarity_at)
    return (
        F.when(invoice.isNull() & suggested.isNull(), "MISSING")
        .when(invoice.isNull(), "GENERATED")
        .when(suggested.isNull() | (invoice == suggested) | near, "VERIFIED")
        .when(F.coalesce(confidence >= confidence_at, F.lit(False)), "REVIEW_REQUIRED")
        .otherwise("REVIEW_REQUIRED_LOW_CONFIDENCE")
    )
