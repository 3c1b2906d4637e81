"""Cleaning of declaration records: ordered reject reasons, duplicates, quality flags, profiles of a dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions import country, numbers, tariff, text

#: Cells that repeat a header.  Fixed values.
HEADERS = ["drž.", "drz.", "tarifa", "tariff", "taric", "opis blaga", "opis", "izvoznik", "prejemnik", "uvoznik", "drz"]
FIELDS = ["export_country", "import_country", "tariff", "description", "net_mass"]


def header_repeat(*cells: Column) -> Column:
    """Whether one of the first five cells that aren't empty is a header, or none is filled."""
    filled = F.filter(F.transform(F.array(*(F.lower(F.trim(c.cast("string"))) for c in cells)), lambda x: F.coalesce(x, F.lit(""))), lambda x: x != "")
    return (F.size(filled) == 0) | F.arrays_overlap(F.slice(filled, 1, 5), F.array(*(F.lit(h) for h in HEADERS)))


def quality_flags(raw: Column, mass: Column, destination: Column) -> Column:
    """JSON array of has_quantity_prefix, statistical_destination and missing_mass."""
    return F.to_json(F.array_compact(F.array(F.when(raw.rlike(r"(?i)^\d+\s*(KOS|KOM|KOSOV)"), "has_quantity_prefix"), F.when(destination == "XS", "statistical_destination"), F.when(mass.isNull(), "missing_mass"))))


def classify(rows: DataFrame, normaliser: Callable[[Column], Column] = tariff.cn8) -> DataFrame:
    """Adds the cleaned columns and reject_reason (null: kept), the first that applies: header_repeat, invalid_tariff, empty_description, invalid_countries, duplicate.

    ``rows`` has FIELDS as text and ``idx``, their order.  Of equal records (countries, code, description, mass to the
    gram) the first is kept.
    """
    description = F.trim(F.coalesce("description", F.lit("")))
    stripped = text.strip_quantity(description)
    out = rows.withColumns({
        "cn8": normaliser(F.col("tariff")), "description": description, "export_code": country.code(F.col("export_country")), "import_code": country.code(F.col("import_country")),
        "net_mass_kg": numbers.parse_mass(F.col("net_mass")), "_header": header_repeat(*(F.col(c) for c in FIELDS)),
    }).withColumn("description_normalized", F.when(stripped != "", stripped).otherwise(description))
    reason = (
        F.when(F.col("_header"), "header_repeat")
        .when(F.col("cn8").isNull(), "invalid_tariff")
        .when((F.length("description") < 3) | (F.lower("description") == "nan"), "empty_description")
        .when(F.col("export_code").isNull() | F.col("import_code").isNull(), "invalid_countries")
    )
    key = [F.when(F.col("_reason").isNotNull(), F.col("idx")), F.col("export_code"), F.col("import_code"), F.col("cn8"), F.col("description_normalized"), F.round("net_mass_kg", 3)]
    # rejected rows are told apart by their order: else those without any field would meet in one task
    out = out.withColumn("_reason", reason).withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("idx")))
    return out.withColumn("reject_reason", F.coalesce("_reason", F.when(F.col("_at") > 1, "duplicate"))).drop("_reason", "_at", "_header")


def records(classified: DataFrame, direction: str) -> DataFrame:
    """The kept records in the stored form."""
    kept = classified.where("reject_reason IS NULL")
    return kept.select(
        F.concat(F.lit(f"{direction}:"), F.col("idx").cast("string")).alias("source_id"), F.col("description").alias("item_description"), "description_normalized", F.col("tariff").alias("original_tariff"), "cn8", tariff.heading(F.col("cn8")).alias("heading_code"),
        F.col("export_code").alias("export_country"), F.col("import_code").alias("import_country"), "net_mass_kg", quality_flags(F.col("description"), F.col("net_mass_kg"), F.col("import_code")).alias("quality_flags"),
    )


def statistics(classified: DataFrame) -> DataFrame:
    """One row: records read, kept, and rejected by reason."""
    reasons = ("header_repeat", "invalid_tariff", "empty_description", "invalid_countries", "duplicate")
    return classified.agg(F.count("*").alias("rows_read"), F.count_if(F.col("reject_reason").isNull()).alias("rows_inserted"), *(F.count_if(F.col("reject_reason") == r).alias(f"skipped_{r}") for r in reasons))


def audit(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of a dataset's profile: records, distinct codes, empty descriptions, bad tariffs and codes, codes that aren't their tariff's, groups of equal keys and the rows beyond their first."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_records"))
    counts = rows.agg(
        F.count("*").alias("records"), F.count_distinct("cn8").alias("unique_cn8"), F.count_if(F.trim(F.coalesce("description", F.lit(""))) == "").alias("empty_descriptions"), F.count_if(F.trim(F.coalesce("tariff", F.lit(""))) == "").alias("invalid_tariffs"),
        F.count_if(F.col("cn8").isNull() | ~F.col("cn8").rlike("^[0-9]{8}$")).alias("invalid_cn8"), F.count_if(~tariff.cn8(F.col("tariff")).eqNullSafe(F.col("cn8"))).alias("normalization_failures"),
    )
    return counts.crossJoin(groups)  # one row each


def top(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k most frequent values, ties by value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def length_histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.length(F.coalesce(column, F.lit(""))).alias("length")).agg(F.count("*").alias("n"))


def confidence_buckets(rows: DataFrame, column: str) -> DataFrame:
    """Counts and percent by band of confidence."""
    band = F.when(F.col(column) >= 0.85, "high").when(F.col(column) >= 0.5, "medium").when(F.col(column) > 0, "low").otherwise("none")
    total = rows.agg(F.count("*").alias("_total"))
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("band", "n", numbers.round_up(F.col("n") * 100 / F.col("_total"), 2).alias("percent"))
