"""What makes a commercial line itself: style, colour and size in its description, a fingerprint, and the lines that are traced.

Defined cases.  Null descriptions hold nothing; a style is taken from the item's code if that is one, else from the description, a
colour after the style, codes, origins and figures are gone: a colour's name, else the first short word of capitals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from customsloom.functions.text import is_metadata, line_type
from customsloom.operators.rollup import goods

#: Style codes, sizes, names of colours.  Fixed values.
STYLE = r"(?i)\b([12][A-Z]{2}[A-Z0-9]{8,})\b"
SIZE = r"(?i)\b(?:size|sz)\s*[-:]?\s*(\d{1,3}|XS|S|M|L|XL|XXL|XXXL)\b"
COLOUR = r"(?i)\b(black|white|navy|blue|red|green|grey|gray|beige|brown|pink|yellow|orange|purple|cream|ivory|khaki|olive|denim)\b"
#: What a description says besides colours, in the order in which it goes.  Fixed values.
BESIDES = [r"(?i)\bHS\s*Code\s*[-–]\s*[\d.\s]+", r"(?i)\bOrigin\s*[-–]\s*[A-Za-z\s]+", r"\b\d{8,10}\b", r"[\d.,]+", r"\s+"]


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def style(description: Column, item_code: Column | None = None) -> Column:
    """The style code in capitals, empty if there is none."""
    own = F.when(_text(item_code).rlike(STYLE), F.trim(item_code)) if item_code is not None else F.lit(None).cast("string")
    return F.upper(F.coalesce(own, F.regexp_extract(_text(description), STYLE, 1)))


def colour(description: Column, style_code: Column) -> Column:
    """A colour's name or code in capitals, empty if there is none."""
    text = _text(description)
    # the style once, whatever its case
    at = F.instr(F.upper(text), F.upper(style_code))
    text = F.when((style_code != "") & (at > 0), F.concat(F.substr(text, F.lit(1), at - 1), F.lit(" "), F.substr(text, at + F.length(style_code)))).otherwise(text)
    for pattern in BESIDES:
        text = F.regexp_replace(text, pattern, " ")
    name = F.regexp_extract(text, COLOUR, 1)
    return F.upper(F.when(name != "", name).otherwise(F.regexp_extract(text, r"\b([A-Z]{2,5})\b", 1)))


def size(description: Column) -> Column:
    return F.upper(F.regexp_extract(_text(description), SIZE, 1))


def with_identity(lines: DataFrame) -> DataFrame:
    """Adds style, colour and size to lines (description and, if there, item_code)."""
    code = F.col("item_code") if "item_code" in lines.columns else None
    rows = lines.withColumn("style", style(F.col("description"), code))
    return rows.withColumns({"colour": colour(F.col("description"), F.col("style")), "size": size(F.col("description"))})


def conflicts(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """(key, style, codes, countries, kind): styles that come with several codes or countries of origin in a document."""
    named = lines.where("style != ''").groupBy(key, "style").agg(F.array_sort(F.collect_set("hs_code")).alias("codes"), F.array_sort(F.collect_set("country")).alias("countries"))
    kind = F.concat_ws(",", F.when(F.size("codes") > 1, "HS_STYLE_MISMATCH"), F.when(F.size("countries") > 1, "COO_STYLE_MISMATCH"))
    return named.withColumn("kind", kind).where("kind != ''")


def traceable(lines: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The lines that are traced: a document's lines of goods with a code, or all but services where it has none."""
    coded = goods(lines).groupBy(key).agg(F.count("*").alias("_coded"))
    text = F.col("description")
    own = (line_type(text) == "GOODS") & ~is_metadata(text) & (_text(F.col("hs_code")) != "")
    return lines.join(coded, key, "left").where(F.when(F.col("_coded") > 0, own).otherwise(line_type(text) != "SERVICE")).drop("_coded")
