"""What texts speak of: families by phrases, rules over words, makers' series, and the candidates that these allow.

Phrase tables of any size meet texts by equi-joins on words or letter groups; small rule lists of a configuration become one
expression each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.text import search_tokens

#: Phrases of one word and at most so many characters match whole words only; letters that longer ones are found by.
SHORT_PHRASE, GROUP = 5, 4
#: Phrases up to which their table is sent to all tasks.
FEW_PHRASES = 1 << 14


def _texts(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(x) for x in values)).cast("array<string>")


def ordered_union(*arrays: Column) -> Column:
    """The distinct elements of arrays in the order in which they are first seen; nulls and null arrays count for nothing."""
    whole = F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))
    return F.array_distinct(F.array_compact(whole))


def difference(a: Column, b: Column) -> Column:
    """Elements of a that b lacks, in a's order."""
    return F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def _groups(text: Column) -> Column:
    """Distinct runs of GROUP characters, all in one pass over the text; the text itself if it is shorter."""
    return F.when(F.length(text) < GROUP, F.array(text)).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GROUP}}}))"), 1)))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def containing(texts: DataFrame, phrases: DataFrame, whole_upto: int = SHORT_PHRASE) -> DataFrame:
    """(id, phrase) of texts (id, text) that hold a phrase, whatever its case.

    Phrases of one word of at most ``whole_upto`` characters must be words of the text, others may stand within words.  The
    first are joined by the word; the others by their first four letters, and then looked for; phrases of fewer letters than
    that hold a word sign and are joined by their first word.  However small they look in
    their files, texts and their words aren't broadcast: a short table of phrases is, a long one is joined by sorting.
    """
    low = texts.select("id", F.lower("text").alias("text")).where("text IS NOT NULL")
    known = phrases.select(F.trim(F.lower("phrase")).alias("phrase")).where("phrase != ''").distinct()
    meet = F.broadcast if known.limit(FEW_PHRASES + 1).count() <= FEW_PHRASES else lambda rows: rows.hint("merge")
    short = (F.length("phrase") <= whole_upto) & ~F.col("phrase").contains(" ")
    words = low.select("id", F.explode(_words(F.col("text"))).alias("phrase")).join(meet(known.where(short)), "phrase")
    long = known.where(~short).withColumn("key", F.substring("phrase", 1, GROUP))
    keys = long.select("key").distinct()
    met = low.select("id", F.explode(_groups(F.col("text"))).alias("key")).join(meet(keys), "key").join(meet(long), "key").select("id", "phrase")
    held = met.join(low.hint("merge"), "id").where(F.col("text").contains(F.col("phrase"))).select("id", "phrase")
    return words.select("id", "phrase").unionByName(held).distinct()


def families(texts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(id, family, place) of the families of ``taxonomy`` (family, phrase) with a phrase in a text, those of the longest phrase first."""
    longest = taxonomy.groupBy("family").agg(F.max(F.length("phrase")).alias("longest"))
    found = containing(texts, taxonomy).join(taxonomy.select("family", F.trim(F.lower("phrase")).alias("phrase")).distinct(), "phrase").select("id", "family").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("longest"), "family"))
    return found.join(longest, "family").select("id", "family", place.alias("place"))


@dataclass(frozen=True)
class Rule:
    """Terms that a text must and must not have, and what follows if it does.  Words count as words, phrases anywhere."""

    name: str
    required: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    anti: tuple[str, ...] = ()
    anti_context: dict[str, tuple[str, ...]] = field(default_factory=dict)  # a term, and those that block the rule beside it
    patterns: tuple[str, ...] = ()  # one of them must match
    families: tuple[str, ...] = ()
    excluded_chapters: tuple[str, ...] = ()
    penalised_headings: tuple[str, ...] = ()
    enrichment: str = ""

    def holds(self, text: Column) -> Column:
        """Over a lower-case text."""

        def some(terms: Sequence[str]) -> Column:
            out = F.lit(False)
            for t in terms:
                out = out | present(text, t)
            return out

        out = F.lit(True)
        for t in self.required:
            out = out & present(text, t)
        for terms in (self.any_of, self.context):
            out = out & some(terms) if terms else out
        out = out & ~some(self.anti)
        for term, blockers in self.anti_context.items():
            out = out & ~(present(text, term) & some(blockers))
        if self.patterns:
            out = out & text.rlike("(?i)" + "|".join(f"(?:{p})" for p in self.patterns))
        return out


def present(text: Column, term: str) -> Column:
    """Whether a lower-case text has a term: a phrase anywhere, a word between word limits."""
    term = term.lower().strip()
    if not term:
        return F.lit(False)
    return text.contains(term) if " " in term else text.rlike(rf"\b\Q{term}\E\b")


def recognise(rows: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """Adds what the rules that hold say: rules, families, excluded_chapters and penalised_headings (arrays, in the rules' order), enriched text."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = [r.holds(low) for r in rules]

    def gathered(of: str) -> Column:
        return ordered_union(*(F.when(h, _texts(getattr(r, of))) for h, r in zip(held, rules, strict=True)), F.array().cast("array<string>"))

    extra = F.array_join(ordered_union(*(F.when(h & F.lit(r.enrichment != ""), F.array(F.lit(r.enrichment))) for h, r in zip(held, rules, strict=True)), F.array().cast("array<string>")), " ")
    names = F.array_compact(F.array(*(F.when(h, r.name) for h, r in zip(held, rules, strict=True)))) if rules else F.array().cast("array<string>")
    out = rows.select("*", names.alias("rules"), *(gathered(x).alias(x) for x in ("families", "excluded_chapters", "penalised_headings")), extra.alias("_extra"))
    new = (F.col("_extra") != "") & ~low.contains(F.lower("_extra"))
    return out.withColumn("enriched", F.when(new, F.trim(F.concat_ws(" ", F.col(text_col), "_extra"))).otherwise(F.col(text_col))).drop("_extra")


def series(text: Column, table: Sequence[tuple[str, tuple[str, ...], str]]) -> Column:
    """Families of makers' series (family, brands, pattern of the model) whose brand and model a text names, each once."""
    words = search_tokens(text, 1)
    return ordered_union(*(F.when(F.arrays_overlap(words, _texts([b.lower() for b in brands])) & text.rlike(f"(?i){pattern}"), F.array(F.lit(family))) for family, brands, pattern in table), F.array().cast("array<string>"))


def chapter_allowed(chapter: Column, allowed: Column, excluded: Column) -> Column:
    """Not among the excluded chapters, and among the allowed ones if there are any; of arrays."""
    return ~F.array_contains(excluded, chapter) & ((F.size(allowed) == 0) | F.array_contains(allowed, chapter))


def in_family_space(chapter: Column, heading: Column, penalised: Column, priors: Column, allowed: Column, restrict: Column) -> Column:
    """Whether a candidate is in its query's space: no penalised heading; a prior heading, or if that isn't required an allowed chapter (any, if none is named)."""
    near = F.substring(heading, 1, 4)
    in_chapter = (F.size(allowed) == 0) | F.array_contains(allowed, chapter)
    return F.when((near != "") & F.array_contains(penalised, near), False).when((F.size(priors) > 0) & F.array_contains(priors, near), True).when((F.size(priors) > 0) & restrict, False).otherwise(in_chapter)


@dataclass(frozen=True)
class Misleading:
    """Candidates that a family's query shouldn't see: of these headings (or of none), with one of the words, without the others."""

    families: tuple[str, ...]
    headings: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()
    without_family: str = ""
    not_heading: str = ""


_FURNITURE = ("furniture_office_chair", "furniture_office_desk", "furniture_cabinet", "furniture_shelving", "furniture_workstation")
#: Common false positives by family.  Fixed values.
MISLEADING = [
    Misleading(("ups",), ("8543",)),
    Misleading(("ups",), ("8536",), any_of=("battery clamp", "motor vehicle", "heading 870")),
    Misleading(("proximity_sensor",), ("9025", "9026"), none_of=("proximity", "inductive")),
    Misleading(("stationery_marker",), ("9612",)),
    Misleading(("frequency_inverter",), all_of=("diesel",), none_of=("inverter", "static converter"), not_heading="8504"),
    Misleading(("electric_motor",), ("87",)),
    Misleading(_FURNITURE, ("9402",), any_of=("dentist", "dental", "barber", "medical", "surgical", "veterinary")),
    Misleading(("stationery_pen",), all_of=("refills for ballpoint",), without_family="stationery_pen_refill"),
    Misleading(("office_printer_consumable",), ("8443",)),
    Misleading(("power_supply", "ups"), ("8504",), all_of=("exceeding 500", "kva")),
    Misleading(("shipping_container",), ("87",)),
    Misleading(("food_pasta",), ("22", "21", "04")),
    Misleading(("electrical_insulation_tester",), ("87",)),
    Misleading(("furniture_fittings",), ("7318", "9403", "9405", "8304", "3926")),
    Misleading(("silicone_sealant", "industrial_adhesive"), ("4821", "3006")),
    Misleading(("protective_coating_paint",), ("4810", "9701", "4821")),
]


def misleading(families_: Column, heading: Column, text: Column, rules: Sequence[Misleading] = MISLEADING) -> Column:
    """Whether a rule drops a candidate of a query with these families (array)."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for r in rules:
        hit = F.arrays_overlap(families_, _texts(r.families))
        if r.headings:
            starts = F.lit(False)
            for h in r.headings:
                starts = starts | heading.startswith(h)
            hit = hit & starts
        if r.not_heading:
            hit = hit & ~heading.startswith(r.not_heading)
        if r.without_family:
            hit = hit & ~F.array_contains(families_, r.without_family)
        if r.any_of:
            some = F.lit(False)
            for w in r.any_of:
                some = some | low.contains(w)
            hit = hit & some
        for w in r.all_of:
            hit = hit & low.contains(w)
        for w in r.none_of:
            hit = hit & ~low.contains(w)
        out = out | hit
    return F.coalesce(out, F.lit(False))


def lookup(rows: DataFrame, nomenclature: DataFrame, code_col: str, key_col: str = "cn_digits") -> DataFrame:
    """Left join with the record of the first eight digits of a code; codes of fewer have none."""
    digits = F.regexp_replace(F.col(code_col), r"\D", "")
    keyed = rows.withColumn("_key", F.when(F.length(digits) >= 8, F.substring(digits, 1, 8)))
    return keyed.join(nomenclature.withColumnRenamed(key_col, "_own"), F.col("_key") == F.col("_own"), "left").drop("_key").withColumnRenamed("_own", key_col)


def longest_prefix_record(rows: DataFrame, nomenclature: DataFrame, id_col: str, code_col: str, key_col: str = "cn_digits", value_col: str = "description", widths: Sequence[int] = (10, 8, 6)) -> DataFrame:
    """(id, width, key, value) of the first record, by key, whose first digits are the code's, at the greatest of the widths where there is one; nulls without."""
    wanted = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).withColumn("width", F.explode(F.array(*map(F.lit, widths)))).where("length(code) >= width").withColumn("prefix", F.expr("substring(code, 1, width)"))
    held = nomenclature.select(F.col(key_col).alias("key"), F.col(value_col).alias("value")).withColumn("width", F.explode(F.array(*map(F.lit, widths)))).where("length(key) >= width").withColumn("prefix", F.expr("substring(key, 1, width)"))
    held = held.groupBy("width", "prefix").agg(F.min(F.struct("key", "value")).alias("r"))
    best = wanted.join(held, ["width", "prefix"]).groupBy("id").agg(F.max_by(F.struct("width", "r"), "width").alias("b"))
    return rows.select(F.col(id_col).alias("id")).join(best, "id", "left").select("id", F.col("b.width").alias("width"), F.col("b.r.key").alias("key"), F.col("b.r.value").alias("value"))


def like_search(tokens: DataFrame, nomenclature: DataFrame, limit: int, least: int = 4, most: int = 8) -> DataFrame:
    """(query_id, cn8, place) of records (cn8, text) that hold one of a query's first ``most`` tokens (query_id, ord, token) anywhere, by code."""
    first = tokens.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).where(F.col("_k") <= most).where(F.length("token") >= least)
    found = containing(nomenclature.select(F.col("cn8").alias("id"), "text"), first.select(F.col("token").alias("phrase")), whole_upto=0)
    hits = first.select("query_id", F.lower("token").alias("phrase")).join(found, "phrase").select("query_id", F.col("id").alias("cn8")).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("cn8"))
    return hits.withColumn("place", place).where(F.col("place") <= limit)
