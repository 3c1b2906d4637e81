"""Reading records of every kind, and writing them: CSV, JSON, sheets, hierarchies, weighted unions, append and keyed overwrite."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from customsloom.functions import numbers, tariff, text

#: Column names that mean the same.  Fixed values.
ALIASES = {
    "export_country": ["export_country", "izvoznik", "drz_izvoza", "država izvoza"],
    "import_country": ["import_country", "prejemnik", "drz_prejemnika", "država prejemnika"],
    "tariff": ["tariff", "tarifa", "cn8", "cn_code", "ctn", "taric", "carinska tarifa"],
    "description": ["description", "item_description", "opis", "opis blaga", "artikel", "itemdescription"],
    "net_mass": ["net_mass", "neto masa", "net_mass_kg", "masa"],
}
#: Keys of extracted items by field, in order of preference.  Fixed values.
ITEM_KEYS = {
    "description": ["description", "item_description", "name"], "quantity": ["quantity", "qty", "amount"], "line_total": ["line_total", "total", "amount", "value"],
    "unit_price": ["unit_price", "price"], "hs_code": ["hs_code", "hs", "tariff_code", "cn_code"], "country_of_origin": ["country_of_origin", "origin", "coo"],
}


def plain_name(name: str) -> str:
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name.strip().lower()))


def by_alias(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """The fields that the columns' names stand for, as text; null where none does.  The first alias that is there wins."""
    own = {plain_name(c): c for c in df.columns}
    found = {f: next((own[plain_name(a)] for a in names if plain_name(a) in own), None) for f, names in aliases.items()}
    return df.select(*((F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(f) for f, c in found.items()))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ";", encoding: str = "UTF-8", other: str = "ISO-8859-1") -> DataFrame:
    """Separated text with a header; bad lines are dropped, names lower-cased.  A file that isn't of the first encoding is read in the other one."""

    def read(encoding: str) -> DataFrame:
        reader = spark.read.option("sep", sep).option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True)
        return (reader.schema(schema) if schema else reader).csv(path)

    df = read(encoding)
    texts = [F.col(f"`{c}`").contains("\ufffd") for c, t in df.dtypes if t == "string"]
    if encoding.upper() != other and (any("\ufffd" in c for c in df.columns) or texts and df.where(F.array_contains(F.array(*texts), F.lit(True))).limit(1).count()):
        df = read(other)
    return df.toDF(*(c.strip().lstrip("\ufeff").lower() for c in df.columns))


def pick_sheet(names: list[str], kind: str) -> str:
    """The first sheet whose name speaks of imports or exports (``kind``), else the first one."""
    words = {"import": ("import", "ais"), "export": ("export", "aes")}[kind]
    return next((n for n in names if any(w in n.lower() for w in words)), names[0])


def read_config(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The entries of one list of a JSON configuration; empty if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("multiLine", True).json(path).select(F.inline(field))
    except AnalysisException:
        return spark.createDataFrame([], "id string")


def active_records(mode: str, seed: DataFrame | None, exports: DataFrame | None, imports: DataFrame | None) -> DataFrame:
    """Records of a mode: ``seed`` at weight 1, or ``full``: exports at 0.6 and imports at 0.4, or the seed at 1 where neither is there."""
    if mode == "full" and (exports is not None or imports is not None):
        return weighted_union({n: (d, w) for n, d, w in (("export", exports, 0.6), ("import", imports, 0.4)) if d is not None})
    if seed is None:
        raise ValueError("no source")
    return weighted_union({"seed": (seed, 1.0)})


def read_json_records(spark: SparkSession, path: str, field: str = "records") -> DataFrame:
    """The records of documents that hold an array of them; blank descriptions and codes go."""
    rows = spark.read.option("multiLine", True).json(path).select(F.inline(field))
    return rows.where((F.trim(F.coalesce("description", F.lit(""))) != "") & (F.trim(F.coalesce(F.col("code").cast("string"), F.lit(""))) != ""))


def read_cases(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One document from each subfolder, with the subfolder's name as case_id."""
    rows = spark.read.option("multiLine", True).json(f"{folder}/*/{name}")
    return rows.withColumn("case_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def read_golden(spark: SparkSession, folder: str, source: str = "invoice-source.json", expected: str = "expected-results.json") -> DataFrame:
    """(case_id, source, expected) of the subfolders that hold both documents."""
    parts = [read_cases(spark, folder, n) for n in (source, expected)]
    a, b = (d.select("case_id", F.struct(*(c for c in d.columns if c != "case_id")).alias(n)) for d, n in zip(parts, ("source", "expected"), strict=True))
    return a.join(b, "case_id")


def replicate(rows: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered."""
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))


def weighted_union(sources: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Sources one after another with their name and weight, records with a full code only."""
    out = None
    for name, (rows, weight) in sources.items():
        part = rows.where(F.length("cn8") == 8).withColumns({"source": F.lit(name), "weight": F.lit(float(weight))})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, the same for a seed: those whose seeded hash is least, which follows no order of the key."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def nomenclature(rows: DataFrame, order: str = "rownum", depth: int = 6) -> DataFrame:
    """Leaf codes of a nomenclature listed in order as (code, dashes, title): the titles of the last ``depth`` levels above, joined by `` > ``.

    A level's title holds until the next title of its own or a higher level.  Rows are ordered within their chapter, so that
    chapters are worked on apart.
    """
    code = tariff.digits(F.col("code"))
    rows = rows.withColumns({"_code": code, "_chapter": F.substring(code, 1, 2), "_level": F.coalesce(F.col("dashes"), F.lit(0))})
    by = Window.partitionBy("_chapter").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    levels = range(10)
    for i in levels:
        here = F.when(F.col("_level") == i, F.struct(F.col(order).alias("at"), F.trim("title").alias("title")))
        rows = rows.withColumns({f"_t{i}": F.last(here, ignorenulls=True).over(by), f"_h{i}": F.max(F.when(F.col("_level") < i, F.col(order))).over(by)})
    valid = [F.when((F.col("_level") >= i) & (F.col(f"_h{i}").isNull() | (F.col(f"_t{i}.at") > F.col(f"_h{i}"))), F.col(f"_t{i}.title")) for i in levels]
    path = F.array_compact(F.array(*valid))
    leaf = rows.where(F.length("_code") >= 8)
    return leaf.select(
        F.substring("_code", 1, 8).alias("cn_digits"), tariff.display(F.col("_code")).alias("cn_code"), F.trim("title").alias("description"), F.col("_chapter").alias("chapter_code"), F.substring("_code", 1, 4).alias("heading_code"),
        F.array_join(F.slice(path, F.greatest(F.size(path) - depth + 1, F.lit(1)), depth), " > ").alias("hierarchy_path"),
    ).withColumn("keywords", F.array_join(text.keywords(F.concat_ws(" ", "description", "hierarchy_path"), ["and", "the", "for", "with", "other"]), " "))


def first_filled(*values: Column) -> Column:
    """The first that is neither null nor blank, as text."""
    return F.coalesce(*(F.when(F.trim(v.cast("string")) != "", F.trim(v.cast("string"))) for v in values))


def items_of(documents: DataFrame, column: str, id_col: str) -> DataFrame:
    """The items of extracted documents (JSON text with an array ``items``): fields by their synonyms, numbers read, positions filled by place."""
    keys = sorted({k for names in ITEM_KEYS.values() for k in names} | {"position_number", "net_weight"})
    schema = "struct<items:array<struct<" + ",".join(f"{k}:string" for k in keys) + ">>>"
    rows = documents.select(F.col(id_col), F.posexplode(F.from_json(column, schema)["items"]).alias("ord", "i"))
    fields = {f: first_filled(*(F.col("i")[k] for k in names)) for f, names in ITEM_KEYS.items()}
    place = F.col("i.position_number").try_cast("int")
    return rows.select(
        id_col, "ord", F.when(place > 0, place).otherwise(F.col("ord") + 1).alias("position"), fields["description"].alias("description"), numbers.parse_quantity(fields["quantity"]).alias("quantity"),
        numbers.parse_locale_number(fields["line_total"]).alias("line_total"), numbers.parse_locale_number(fields["unit_price"]).alias("unit_price"), tariff.normalise(fields["hs_code"])[0].alias("hs_code"),
        fields["country_of_origin"].alias("country"), F.when(F.col("i.net_weight").isNotNull(), numbers.parse_locale_number(F.col("i.net_weight"))).alias("net_weight"),
    )


def merged(structured: dict[str, Column], found: dict[str, Column]) -> list[Column]:
    """Field by field the structured value, else the one found in the text."""
    return [first_filled(v, found[k]).alias(k) if k in found else first_filled(v).alias(k) for k, v in structured.items()]


def corpus(recognised: Column, embedded: Column, *fields: Column) -> Column:
    """Recognised text, the embedded one unless its first 400 characters are in it, and fields, line by line."""
    new = F.when(~F.coalesce(F.contains(recognised, F.substring(embedded, 1, 400)), F.lit(False)), embedded)
    parts = F.array_compact(F.array(*(F.when(F.trim(p) != "", F.trim(p)) for p in (recognised, new, *fields))))
    return F.array_join(parts, "\n")


def without_page_marks(corpus_text: Column) -> Column:
    return F.regexp_replace(corpus_text, r"(?im)^\s*(?:---+\s*)?(?:page|stran|seite)\s+\d+(?:\s*(?:/|of|od|von)\s*\d+)?\s*(?:---+)?\s*$\n?", "")


def available(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read and has a row."""
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.parquet(path).limit(1).count())
    except AnalysisException:
        return False


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Adds rows to a table of files, by partition columns if named."""
    (rows.write.mode("append").partitionBy(*partitions) if partitions else rows.write.mode("append")).parquet(path)


def append_run(rows: DataFrame, path: str, payload: list[str]) -> None:
    """An audit trail: id, time and JSON of the payload columns beside the rest."""
    out = rows.withColumns({"run_id": F.expr("uuid()"), "at": F.current_timestamp(), "payload": F.to_json(F.struct(*payload))}).drop(*payload)
    append(out, path)


def write_declaration_csv(rows: DataFrame, path: str) -> None:
    """A semicolon table with figures in the German manner, quoted where needed."""
    shown = [numbers.format_declaration(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").option("sep", ";").option("header", True).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').csv(path)


def rebuild(rows: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Replaces a table and its meta data (key, value), which lies beside it."""
    rows.write.mode("overwrite").parquet(path)
    rows.sparkSession.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}.meta")


def write_statistics(row: DataFrame, path: str) -> None:
    """The figures of a one-row table as (key, value) in JSON."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value")) for c in row.columns))
    row.select(F.inline(pairs)).write.mode("append").json(path)


def cell(value: Column) -> Column:
    """A cell of a semicolon table: quoted where it holds a semicolon, a quote or a line break."""
    text_ = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text_.rlike('[;"\\r\\n]'), F.concat(F.lit('"'), F.regexp_replace(text_, '"', '""'), F.lit('"'))).otherwise(text_)


def declaration_lines(header: dict[str, str], rows: DataFrame, trace: DataFrame, order: str) -> DataFrame:
    """(block, ord, line) of a declaration's file: header, table and trace blocks with a blank line between them; figures in the German manner."""
    spark = rows.sparkSession
    shown = lambda df: [numbers.format_declaration(F.col(c)) if t == "double" else F.col(c) for c, t in df.dtypes if c != order]
    top = spark.createDataFrame([(0, i, k, v) for i, (k, v) in enumerate(header.items())] + [(1, 0, "", None)], "block int, ord bigint, k string, v string")
    out = top.select("block", "ord", F.when(F.col("v").isNull(), "").otherwise(F.concat_ws(";", cell(F.col("k")), cell(F.col("v")))).alias("line"))
    for block, df in ((2, rows), (4, trace)):
        names = ";".join(c for c in df.columns if c != order)
        head = spark.createDataFrame([(block, -1, names)] + ([(3, 0, "")] if block == 2 else []), "block int, ord bigint, line string")
        out = out.unionByName(head).unionByName(df.select(F.lit(block).alias("block"), F.col(order).cast("bigint").alias("ord"), F.concat_ws(";", *(cell(c) for c in shown(df))).alias("line")))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (block, ord, line) as text in order: one document of bounded size, with CRLF and a byte order mark."""
    first = F.min(F.struct("block", "ord")).over(Window.partitionBy())
    marked = F.when(F.struct("block", "ord") == first, F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line"))
    lines.withColumn("line", marked).orderBy("block", "ord").coalesce(1).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def allocation_lines(result: DataFrame, title: str, label: str) -> DataFrame:
    """(block, ord, line) of a report of route costs (total_km, domestic_km, foreign_km, domestic_percent, domestic_cost, foreign_cost, route_id), one block a route: quoted names and values."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), '"', '""'), F.lit('"'))
    whole, money = lambda c: F.format_string("%.0f", F.col(c)), lambda c: F.format_string("%.2f", F.col(c))
    pairs = [
        (F.lit(title), None), (F.lit("Route"), F.col("route_id")), (F.lit("Metric"), F.lit("Value")), (F.lit("Total Route (km)"), whole("total_km")), (F.lit(f"{label} Distance (km)"), whole("domestic_km")), (F.lit("Other Distance (km)"), whole("foreign_km")),
        (F.lit(f"{label} Share"), F.format_string("%.1f%%", F.col("domestic_percent"))), (F.lit("Other Share"), F.format_string("%.1f%%", 100 - F.col("domestic_percent"))), (F.lit(f"{label} Amount (EUR)"), money("domestic_cost")), (F.lit("Other Amount (EUR)"), money("foreign_cost")),
    ]
    rows = F.array(*(F.struct(F.lit(i).cast("bigint").alias("ord"), (quoted(k) if v is None else F.concat_ws(";", quoted(k), quoted(v))).alias("line")) for i, (k, v) in enumerate(pairs)))
    return result.select(F.col("route_id").alias("block"), F.inline(rows))


def review_lines(summary: DataFrame, defects: DataFrame) -> DataFrame:
    """(block, ord, line) of a review in Markdown: a list of a one-row summary's figures, and a table of defects (field, failures, ids) with the commonest first."""
    spark = summary.sparkSession
    figures = F.array(*(F.struct(F.lit(i).cast("bigint").alias("ord"), F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit("–"))).alias("line")) for i, c in enumerate(summary.columns)))
    heads = spark.createDataFrame([(0, 0, "# Review"), (0, 1, ""), (2, -3, ""), (2, -2, "| " + " | ".join(defects.columns) + " |"), (2, -1, "|" + " --- |" * len(defects.columns))], "block int, ord bigint, line string")
    table = defects.select(F.struct(F.lit(2).alias("block"), F.row_number().over(Window.orderBy(F.desc(defects.columns[1]), defects.columns[0])).cast("bigint").alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in defects.columns)), F.lit(" |")).alias("line")).alias("r")).select("r.*")
    return heads.unionByName(summary.select(F.lit(1).alias("block"), F.inline(figures))).unionByName(table)
