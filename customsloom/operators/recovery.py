"""Lines read a second time: whether they are good enough to replace the first, and fields that mustn't change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from customsloom.functions.numbers import round_up

#: Least number of lines and least score of a second reading.  Fixed values.
LEAST_LINES, LEAST_SCORE = 3, 70
#: Words of addresses and footers.  Fixed values.
FOOTER = (
    r"(?i)\b(?:rue|avenue|boulevard|street|cesta|bp\s*\d*|po box|postal|zip|tel\.?|phone|fax|email|www\.|iban|swift|bank|authori[sz]ed|exporter|origin declaration|products covered by this|preferential origin|"
    r"invoice declaration|sales representative|signature)\b"
)
LOCKED = ["quantity", "unit_price", "line_total"]


def _there(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def line_quality(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Per invoice: lines, quality (percent of lines with description, quantity and total that are no footer), footer_rows, code_ratio (percent)."""
    footer = F.concat_ws(" ", *(F.col(c) for c in ("item_code", "description", "country", "code"))).rlike(FOOTER)
    whole = _there(F.col("description")) & _there(F.col("quantity")) & _there(F.col("line_total")) & ~footer
    coded = F.regexp_replace(F.coalesce("code", F.lit("")), r"[\s.\-–—]+", "").rlike(r"^[0-9]{6,12}$")
    counts = lines.groupBy(key).agg(F.count("*").alias("lines"), F.count_if(whole).alias("_good"), F.count_if(footer).alias("footer_rows"), F.count_if(coded).alias("_coded"))
    percent = lambda c: round_up(F.col(c) / F.col("lines") * 100, 0).cast("int")
    return counts.select(key, "lines", percent("_good").alias("quality"), "footer_rows", percent("_coded").alias("code_ratio"))


def lost_fields(**fields: tuple[Column, Column]) -> Column:
    """Names of the header fields that were there before and aren't after; an array."""
    return F.array_compact(F.array(*(F.when(_there(before) & ~_there(after), F.lit(name)) for name, (before, after) in fields.items())))


def recovery_gate(lines: Column, quality: Column, footer_rows: Column, code_ratio: Column, totals: Column, lost: Column) -> tuple[Column, Column, Column]:
    """(score, reasons against, accepted) of a second reading; ``totals`` is PASS, WARNING or FAIL, ``lost`` the array of lost fields."""
    score = F.least(lines / LEAST_LINES, F.lit(1.0)) * 20 + F.when(totals == "PASS", 35).when(totals == "WARNING", 10).otherwise(0) + quality * 0.2 + F.when(F.size(lost) == 0, 15).otherwise(0) + code_ratio * 0.1
    score = round_up(score, 0).cast("int")
    reasons = F.array_compact(
        F.concat(
            F.array(F.when(lines < LEAST_LINES, "TOO_FEW_LINES"), F.when(totals == "FAIL", "TOTALS_FAIL"), F.when(footer_rows > 0, "FOOTER_ROWS")),
            F.transform(F.array(*(F.lit(x) for x in ("invoice_number", "invoice_date", "incoterms"))), lambda f: F.when(F.array_contains(lost, f), F.concat(F.lit("LOST_"), F.upper(f)))),
            F.array(F.when(score < LEAST_SCORE, "LOW_SCORE")),
        )
    )
    return score, reasons, F.size(reasons) == 0


def replaced(primary: DataFrame, recovered: DataFrame, decisions: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The lines of each invoice: the second reading's where it is accepted (``decisions``: key, accepted) and has more lines, else the first's; ``recovered`` tells which."""
    counts = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    take = decisions.where("accepted").select(key).join(counts(recovered, "_new"), key).join(counts(primary, "_old"), key, "left").where("_new > coalesce(_old, 0)").select(key)
    return primary.join(take, key, "left_anti").withColumn("recovered", F.lit(False)).unionByName(recovered.join(take, key, "left_semi").withColumn("recovered", F.lit(True)))


def locked(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str] = LOCKED) -> DataFrame:
    """The rows of ``after`` with the locked fields as they were in ``before``; ``overwrites`` names those that a change was kept from."""
    old = before.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_known"))
    both = after.join(old, keys, "left")
    known = F.coalesce("_known", F.lit(False))
    changed = F.array_compact(F.array(*(F.when(known & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)))
    return both.withColumn("overwrites", changed).withColumns({f: F.when(known, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).drop("_known", *(f"_{f}" for f in fields))
