"""Entities in product texts: phrases of a dictionary with their places, model codes, and what follows from them.

Phrases are found by an automaton over a whole dictionary (Aho-Corasick), so that a text is read once however many phrases there
are.  A dictionary of up to ``MOST_CHARS`` is sent to the tasks; a larger one goes in parts of that size, one reading of the texts
each, whose finds are brought together by text before overlaps are resolved.

Of overlapping finds the leftmost counts, and of those that begin at one place the longest (then the one of least rank, then value).
Kinds are resolved apart, as a brand may stand within a family's phrase, unless ``across`` is set.  Phrases that must be whole
words have no letter, digit or ``_`` beside them.  Case counts for nothing.  Null texts and blank phrases have no finds; places are
characters from 0, the end exclusive; repeated ids are texts of their own in ``spans``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.operators.matching import ordered_union, series as series_of

#: Characters of phrases, with 32 for each, that are sent to the tasks at once.
MOST_CHARS = 16 << 20
_FIELDS = ["kind", "value", "start", "stop", "rank"]
_SPAN = "array<struct<kind: string, value: string, start: int, stop: int, rank: int>>"

#: Codes of vehicles' and of industrial models.  Fixed values.
VEHICLE_MODELS = [
    r"\b([a-z]{2,5})\s+(\d{2,4})\b", r"\b([a-z]{2,5})\s*[-]?\s*(\d{2,4})\s*(\d{2,4})?\b", r"\b(\d{2})\.(\d{3})\b",
    r"\b(actros|tgx|xf|stralis|eurocargo|megaspace)\s*(\d{2,4})\b", r"\b(\d{4})\b",
]
INDUSTRIAL_MODELS = [
    r"\b([A-Z]{2,5})-([A-Z0-9]{1,8})\b", r"\b([A-Z]{2,4}\d{2,4}[A-Z0-9-]*)\b", r"(?i)\b(6ES[0-9A-Z-]+)\b", r"(?i)\b(3RT\d+[A-Z0-9-]*)\b",
    r"\b([A-Z]{2,5})(\d{4,6})\b", r"\b([A-Z]{2,6}-\d{2,6}[A-Z0-9]*)\b",
]
#: Families of sensors and of drives.  Fixed values.
SENSORS = ("sensor", "temperature_sensor", "pressure_sensor", "proximity_sensor")
DRIVES = ("frequency_inverter", "power_supply", "ups", "electric_motor")


def _low(text: str) -> str:
    """Lower case, character by character where it would change places."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def resolved(finds: list[tuple[str, str, int, int, int]], across: bool) -> list[tuple[str, str, int, int, int]]:
    """Leftmost, then longest, of overlapping (kind, value, start, stop, rank), each kind for itself unless across; by place."""
    out, ends = [], {}
    for f in sorted(set(finds), key=lambda f: (f[2], -f[3], f[4], f[1], f[0])):
        group = "" if across else f[0]
        if f[2] >= ends.get(group, 0):
            out.append(f)
            ends[group] = f[3]
    return out


def _finder(entries: list[tuple[str, str, str, bool, int]]):
    """A function from a text to all finds of (kind, value, phrase, whole, rank)."""
    import ahocorasick

    by_phrase: dict[str, list[tuple[str, str, bool, int]]] = {}
    for kind, value, phrase, whole, rank in entries:
        if key := _low(phrase.strip()):
            by_phrase.setdefault(key, []).append((kind, value, whole, rank))
    machine = ahocorasick.Automaton()
    for phrase, meanings in by_phrase.items():
        machine.add_word(phrase, (len(phrase), meanings))
    machine.make_automaton() if by_phrase else None

    def finds(text: str | None) -> list[tuple[str, str, int, int, int]]:
        if not text or not by_phrase:
            return []
        low, out = _low(text), []
        for last, (size, meanings) in machine.iter(low):
            start, stop = last + 1 - size, last + 1
            alone = not (start and _word(low[start - 1])) and not (stop < len(low) and _word(low[stop]))
            out += [(kind, value, start, stop, rank) for kind, value, whole, rank in meanings if alone or not whole]
        return out

    return finds


def spans(texts: DataFrame, dictionary: DataFrame, across: bool = False, most_chars: int | None = None) -> DataFrame:
    """(id, spans) of every text (id, text): the resolved finds of the dictionary (kind, value, phrase, whole, rank), by place."""
    spark, kind = texts.sparkSession, dict(texts.dtypes)["id"]
    known = dictionary.select("kind", "value", "phrase", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce(F.col("rank").cast("int"), F.lit(0)).alias("rank")).where("trim(phrase) != '' AND kind IS NOT NULL").distinct()
    size = known.agg(F.sum(F.length("phrase") + 32)).first()[0] or 0
    parts = max(1, math.ceil(size / (most_chars or MOST_CHARS)))
    found = None
    for part in range(parts):
        mine = known if parts == 1 else known.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])

        def searched(batches: Iterator[pa.RecordBatch], sent=sent, whole=parts == 1) -> Iterator[pa.RecordBatch]:
            finds = _finder(sent.value)
            for b in batches:
                rows = [finds(t) for t in b.column(1).to_pylist()]
                yield _batch(b.column(0), [resolved(r, across) if whole else r for r in rows])

        rows = (texts.select("id", "text") if parts == 1 else texts.select(F.struct("id", F.xxhash64("text").alias("h")).alias("id"), "text"))
        one = rows.mapInArrow(searched, f"id {kind if parts == 1 else rows.schema['id'].dataType.simpleString()}, spans {_SPAN}")
        found = one if found is None else found.unionAll(one)
    if parts == 1:
        return found

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[tuple(s[f] for f in _FIELDS) for part in r for s in part] for r in b.column(2).to_pylist()]
            ids, many = b.column(0), b.column(1).to_pylist()
            place = [i for i, n in enumerate(many) for _ in range(n)]
            done = [resolved(r, across) for r in rows]
            yield _batch(ids.take(pa.array(place, pa.int64())), [done[i] for i in place])

    grouped = found.groupBy("id").agg((F.count("*") / parts).cast("int").alias("n"), F.collect_list("spans").alias("spans"))
    return grouped.select(F.col("id.id").alias("id"), "n", "spans").mapInArrow(settled, f"id {kind}, spans {_SPAN}")


def _batch(ids: pa.Array, rows: list[list[tuple[str, str, int, int, int]]]) -> pa.RecordBatch:
    of = pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("rank", pa.int32())])
    return pa.RecordBatch.from_arrays([ids, pa.array([[dict(zip(_FIELDS, f, strict=True)) for f in r] for r in rows], pa.list_(of))], ["id", "spans"])


def model_spans(text: Column, patterns: Sequence[str]) -> Column:
    """What the patterns find, in their order and then by place, each once whatever its case."""
    every = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), 0), lambda x: F.trim(x)) for p in patterns))
    low = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def model_tokens(found: Column, never_rank: Sequence[str]) -> Column:
    """Words of model codes that say nothing about the goods: numbers of two digits and more, words of two to five letters, named prefixes."""
    tokens = F.flatten(F.transform(found, lambda s: F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1)))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike("^([0-9]{2,}|[a-z]{2,5})$") | t.isin(*never_rank) if never_rank else t.rlike("^([0-9]{2,}|[a-z]{2,5})$"))))


def entities(
    texts: DataFrame, dictionary: DataFrame, profiles: DataFrame, implied: DataFrame, series: Sequence[tuple[str, tuple[str, ...], str]] = (), never_rank: Sequence[str] = (), penalised: Sequence[tuple[str, Sequence[str]]] = (),
) -> DataFrame:
    """What every text (id, text; one row an id) speaks of.

    The dictionary's kinds are vehicle_brand, brand, condition, vehicle and family.  ``profiles`` (value, chapters, headings, terms) say what
    a vehicle type or family stands for, ``implied`` (brand, vehicle) which type a vehicle's brand means where no phrase names one,
    ``series`` (family, brands, pattern) makers' series, ``penalised`` (heading, families) headings that speak against a family.

    Columns: brands, vehicles, families, models, excluded (words that mustn't be searched for), chapters, headings, terms, penalised (arrays),
    condition, is_vehicle, is_sensor, is_automation.
    """
    found = spans(texts, dictionary).select("id", F.explode_outer("spans").alias("s")).select("id", "s.kind", "s.value", "s.rank").distinct()
    by_rank = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*k), F.struct("rank", "value")))), lambda x: x["value"])
    named = found.groupBy("id").agg(
        by_rank(["vehicle_brand"]).alias("makes"), by_rank(["brand"]).alias("others"), by_rank(["vehicle"]).alias("vehicles"), by_rank(["family"]).alias("families"), F.get(by_rank(["condition"]), F.lit(0)).alias("condition")
    )
    rows = texts.select("id", F.coalesce("text", F.lit("")).alias("text")).join(named, "id")
    rows = rows.join(implied.select(F.col("brand").alias("_make"), F.col("vehicle").alias("_implied")), F.get("makes", F.lit(0)) == F.col("_make"), "left").drop("_make")
    none = F.array().cast("array<string>")
    by_series = series_of(F.col("text"), series) if series else none
    lone = F.when((F.size("vehicles") == 0) & F.col("_implied").isNotNull(), F.array("_implied")).otherwise(F.col("vehicles"))
    rows = rows.withColumns({"brands": ordered_union(F.col("makes"), F.col("others")), "by_series": by_series}).withColumns({"vehicles": F.array_distinct(lone), "families": ordered_union(F.col("families"), F.col("by_series"))})
    rows = rows.withColumns({"models": model_spans(F.col("text"), [f"(?i){p}" for p in VEHICLE_MODELS] + INDUSTRIAL_MODELS), "is_vehicle": (F.size("vehicles") > 0) | (F.size("makes") > 0)})
    low = F.lower("text")
    unclear = (F.size("others") > 0) & low.rlike(r"\b(sensor|senzor|transducer|transmitter|plc|automation)\b")
    sensor = F.arrays_overlap("families", F.array(*map(F.lit, SENSORS)))
    automation = F.array_contains("families", "industrial_automation") | F.arrays_overlap("families", F.array(*map(F.lit, DRIVES)))
    rows = rows.withColumns({"_sensor": sensor, "_automation": automation})
    neither = ~F.col("_sensor") & ~F.col("_automation") & unclear
    brand_words = F.when(F.size("by_series") == 0, F.filter(F.flatten(F.transform("brands", lambda b: F.split(F.lower(b), r"[\s+/&]+"))), lambda w: F.length(w) >= 3)).otherwise(none)
    years = F.when(F.col("is_vehicle"), F.regexp_extract_all("text", F.lit(r"\b(\d{3,4})\b"), 1)).otherwise(none)
    excluded = F.array_sort(F.array_distinct(F.concat(model_tokens(F.col("models"), never_rank), brand_words, years)))
    against = F.array_compact(F.array(*(F.when(F.arrays_overlap("families", F.array(*map(F.lit, of))), heading) for heading, of in penalised))) if penalised else none
    rows = rows.select(
        "id", "brands", "vehicles", "families", "condition", "models", excluded.alias("excluded"), "is_vehicle", (F.col("_sensor") | (neither & low.rlike(r"\b(sensor|senzor)\b"))).alias("is_sensor"),
        (F.col("_automation") | (neither & low.rlike(r"\b(plc|automation|controller)\b"))).alias("is_automation"), against.alias("penalised"),
    )
    meant = rows.select("id", F.explode(F.array_union("vehicles", "families")).alias("value")).join(profiles, "value").groupBy("id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("chapters", "headings", "terms")))
    out = rows.join(meant, "id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("chapters", "headings", "terms")})


def flat_spans(found: DataFrame) -> DataFrame:
    """(id, kind, value, start, stop, n): a row a find, numbered by place within its text."""
    rows = found.select("id", F.explode("spans").alias("s")).select("id", "s.kind", "s.value", "s.start", "s.stop")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("start", "stop", "kind", "value")))
