"""Invoice dates in text, and their age."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_invoice_date(text: Column) -> Column:
    """YYYY-MM-DD, or D/M/Y and M/D/Y with slashes or dots: a part over 12 is the day; day first where both could be."""
    s = F.trim(text)
    pattern = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    a, b, year = (F.regexp_extract(s, pattern, i).try_cast("int") for i in (1, 2, 3))
    month_first = (b > 12) & (a <= 12)
    day, month = F.when(month_first, b).otherwise(a), F.when(month_first, a).otherwise(b)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date"))
    return F.coalesce(iso, F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date"))


def date_readiness(date: Column, today: Column, most_days: int = 180) -> Column:
    """INVOICE_DATE_IN_FUTURE, INVOICE_DATE_OLDER_THAN_180_DAYS or null."""
    return F.when(date > today, "INVOICE_DATE_IN_FUTURE").when(F.datediff(today, date) > most_days, f"INVOICE_DATE_OLDER_THAN_{most_days}_DAYS")
