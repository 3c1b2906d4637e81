"""Numbers in dirty text, and the rounding rules of the domain, as Column expressions.

Rounding is half towards plus infinity on the scaled double,
``floor(x * 10^n + 0.5) / 10^n``, everywhere but where half-even is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x worked out once a row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def round_up(x: Column, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def round_money(x: Column) -> Column:
    return round_up(x, 2)


def round_weight(x: Column) -> Column:
    return round_up(x, 3)


def round_even(x: Column, digits: int = 0) -> Column:
    """Half-even on the scaled double."""
    scale = float(10**digits)
    y = x * scale
    low = F.floor(y)
    part = y - low
    return F.when(part > 0.5, low + 1).when(part < 0.5, low).otherwise(low + F.pmod(low, F.lit(2))) / scale


def round_to_5(x: Column) -> Column:
    """Nearest multiple of 5, half-even."""
    return round_even(x / 5) * 5


def _number(text: Column) -> Column:
    """The number a text starts with, 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^-?(\d+\.?\d*|\.\d+)", 0).try_cast("double"), F.lit(0.0))


def parse_locale_number(text: Column) -> Column:
    """European (1.234,50), US (1,234.50) and spaced numbers; 0 where there is none.

    With both separators the last is the decimal one.  A single comma is decimal before one to three digits, a single dot
    before one or two; otherwise they separate thousands.
    """
    return once(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d,.\-]", ""), _of_locale)


def _of_locale(s: Column) -> Column:
    comma, dot = s.contains(","), s.contains(".")
    no_dots, no_commas = F.regexp_replace(s, r"\.", ""), F.regexp_replace(s, ",", "")
    european = F.length(s) - F.instr(F.reverse(s), ",") > F.length(s) - F.instr(F.reverse(s), ".")
    commas, dots = F.size(F.split(s, ",")) - 1, F.size(F.split(s, r"\.")) - 1
    tail = F.when(comma, F.length(F.substring_index(s, ",", -1))).otherwise(F.length(F.substring_index(s, ".", -1)))
    plain = (
        F.when(comma & dot & european, F.regexp_replace(no_dots, "^([^,]*),", "$1."))
        .when(comma & dot, no_commas)
        .when(comma & (commas == 1) & tail.between(1, 3), F.regexp_replace(s, ",", "."))
        .when(comma, no_commas)
        .when(dot & ~((dots == 1) & tail.between(1, 2)), no_dots)
        .otherwise(s)
    )
    return _number(plain)


def parse_eu_strict(text: Column) -> Column:
    """Dots are always thousands and commas decimal, so that 1123.50 is 112350."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\d,.\-]", ""), r"\.", ""), ",", ".")
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def parse_quantity(text: Column) -> Column:
    """Counts with a unit behind them and thousands in groups of three; never negative."""
    s = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)\s*(?:pcs|pc|st|kg|m|l|stk|pz|eur)\.?\s*$", ""))
    tight = F.regexp_replace(s, r"\s", "")
    grouped = s.rlike(r"^\d{1,3}(\s\d{3})+$") | tight.rlike(r"^\d{1,3}(\.\d{3})+$") | tight.rlike(r"^\d{1,3}(,\d{3})+$")
    return F.when(grouped, F.regexp_replace(tight, "[.,]", "").try_cast("double")).otherwise(F.greatest(parse_locale_number(s), F.lit(0.0)))


def quantity_consistent(quantity: Column, unit_price: Column, line_total: Column, tolerance: float = 0.03) -> Column:
    """Whether total / quantity is near the price; true where price or total is missing."""
    known = F.coalesce(line_total > 0, F.lit(False)) & F.coalesce(unit_price > 0, F.lit(False))
    return F.coalesce(quantity > 0, F.lit(False)) & F.when(known, F.abs(line_total / F.when(quantity > 0, quantity) - unit_price) / unit_price <= tolerance).otherwise(True)


def repair_quantity(quantity: Column, unit_price: Column, line_total: Column, tolerance: float = 0.03) -> Column:
    """The whole quantity that total and price imply where the given one doesn't fit them."""
    known = F.coalesce(line_total > 0, F.lit(False)) & F.coalesce(unit_price > 0, F.lit(False))
    implied = F.when(known, line_total / unit_price)
    whole = F.floor(implied + 0.5).cast("double")
    good = (whole >= 2) & (F.abs(implied - whole) / whole <= tolerance) & quantity_consistent(whole, unit_price, line_total, tolerance)
    return F.when(known & ~quantity_consistent(quantity, unit_price, line_total, tolerance) & F.coalesce(good, F.lit(False)), whole).otherwise(quantity)


def parse_mass(text: Column) -> Column:
    """Comma as the decimal sign and nothing else mended: 1.234,5 is null."""
    s = F.regexp_replace(F.trim(text), ",", ".")
    return F.when(F.lower(s).isin("", "nan"), None).otherwise(s.try_cast("double"))


def parse_weight(text: Column) -> Column:
    """A plain decimal with dot or comma and at most three decimals, positive; else null."""
    s = F.trim(text)
    return F.when(s.rlike(r"^\d+([.,]\d{1,3})?$"), F.regexp_replace(s, ",", ".").try_cast("double"))


def money_token(text: Column) -> Column:
    """The first amount of money in a text, null without one."""
    found = F.regexp_extract(text, r"\d{1,3}(?:[.,\s]\d{3})*[.,]\d{2}(?!\d)|\d+[.,]\d{2}(?!\d)", 0)
    return F.when(found != "", round_money(parse_locale_number(found)))


def monetary_candidates(text: Column, excluded: str = r"(?i)vat|ddv|mwst|tax|rate|%") -> Column:
    """All amounts in the lines of a text but those of lines with an excluded word, and dates."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(excluded))
    cleaned = F.regexp_replace(F.array_join(lines, "\n"), r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b", " ")
    return F.transform(F.regexp_extract_all(cleaned, F.lit(r"(\d{1,3}(?:[.,]\d{3})*[.,]\d{2}|\d+[.,]\d{2})(?!\d)"), 1), parse_locale_number)


def largest_amount(text: Column) -> Column:
    return F.array_max(monetary_candidates(text))


def format_declaration(x: Column) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(round_money(x), 2), ",.", ".,")
