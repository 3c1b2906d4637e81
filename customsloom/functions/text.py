"""Texts of goods: tokens, n-grams, folding, similarity, ordered rewriting, kinds of invoice lines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Patterns of lines that are no goods.  Fixed values.
SERVICE = [
    r"^\s*transport\s*$", r"\bfreight\b", r"\bmainfreight\b", r"\bshipping\b", r"\bshipping\s+cost\b", r"\bcourier\b", r"\blogistics\b", r"\bservice\s*(?:charge|fee|cost)?\b",
    r"\btransport\s+costs?\b", r"\bdelivery\s+charge\b", r"\bfreight\s+forward", r"\bexport\s+costs\b", r"stroški\s+izvoza", r"\bprevoz\b", r"\bcarriage\b",
]
PACKAGING = [
    r"\bpallet(?:s|te)?\b", r"\bpal\b", r"\bcarton(?:s)?\b", r"\bctn(?:s)?\b", r"\bbox(?:es)?\b", r"\bcrate(?:s)?\b", r"\bpackaging\b", r"\bpacking\s+material\b", r"\bwooden\s+case\b",
    r"\bwooden\s+box\b", r"^\s*(?:1\s+)?(?:pallet|carton|box|crate)\b",
]
METADATA = [
    r"\b(?:chassis|šasij|sasij|vin|serial\s+no|serijska)\b", r"\b(?:engine\s+power|motor(?:na)?\s+moč|moč\s+motorja|kw|kilowatt)\b", r"\b(?:cubic\s+capacity|working\s+volume|prostornin|cm3|ccm|cm³)\b",
    r"\b(?:vat|ddv|davek|tax\s+id|eori|iban|swift|payment|plačil|plačilo)\b", r"\b(?:invoice\s+no|račun\s*št|datum|date|incoterms|total|skupaj|znesek)\b", r"\b(?:terms\s+and\s+conditions|legal|warranty|garancij)\b", r"^\s*\d{17}\s*$", r"^\s*[A-HJ-NPR-Z0-9]{17}\s*$",
]
VEHICLE = [
    r"\bvehicle\b", r"\btruck\b", r"\blorry\b", r"\bautomobile\b", r"\biveco\b", r"\bmercedes\b", r"\b\d+\s*actros\b", r"\bdaf\b", r"\bscania\b", r"\bvolvo\s+truck\b", r"\beurocargo\b",
    r"\btovorno\s+vozilo\b", r"\bkompletn", r"\bmotor\s+vehicle\b", r"\blkw\b",
]
VEHICLE_PART = r"\b(?:part|spare\s+part|component|replacement|accessory|rezervni\s+del|komponent)\b"

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def any_of(patterns: list[str]) -> str:
    """One pattern that is found where one of them is; those that begin at a word's boundary (and have no alternatives outside of groups) look for it once."""
    words = [p for p in patterns if p.startswith(r"\b") and "|" not in _outside_groups(p)]
    whole = [f"(?:{p})" for p in patterns if p not in words]
    return "(?i)" + "|".join([*whole, *([r"\b(?:" + "|".join(f"(?:{p[2:]})" for p in words) + ")"] if words else [])])


def _outside_groups(pattern: str) -> str:
    """What stands outside of round brackets; escaped signs and sets of signs are left out."""
    out, depth = "", 0
    for sign in re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", pattern):
        depth += (sign == "(") - (sign == ")")
        out += sign if depth == 0 else ""
    return out


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def search_tokens(text: Column, least: int = 4) -> Column:
    """Runs of a-z and 0-9 of at least ``least`` characters; other letters separate."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"([a-z0-9]{{{max(1, least)},}})"), 1)


def words_of(texts: pa.StringArray, letters: np.ndarray, least: int = 1) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, and of each word in order its number, its text's, the byte before it) of whole texts within a task: runs of at least ``least`` bytes of ``letters`` (true or false by byte); 10 is before a text's first."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    signs = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends, letter = ends - ends[0], letters[signs]
    begins, stops = np.zeros(len(signs) + 1, bool), np.zeros(len(signs) + 1, bool)
    begins[:-1], stops[1:] = letter, letter
    begins[1:-1] &= ~letter[:-1]
    stops[1:-1] &= ~letter[1:]
    edge = np.unique(ends)  # a word ends with its text
    begins[edge[edge < len(signs)]] = letter[edge[edge < len(signs)]]
    stops[edge[edge > 0]] = letter[edge[edge > 0] - 1]
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops)
    if least > 1:
        long = stop - begin >= least
        begin, stop = begin[long], stop[long]
        change = np.zeros(len(signs) + 1, np.int8)
        change[begin] += 1
        change[stop] -= 1
        letter = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    at = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(stop - begin, out=at[1:])
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(at), pa.py_buffer(signs[letter])).dictionary_encode()
    text = (np.searchsorted(ends, begin, "right") - 1).astype(np.int32)
    return words.dictionary, words.indices.to_numpy(), text, np.where(begin == ends[text], 10, signs[begin - 1] if len(begin) else 0)


def keywords(text: Column, stopwords: list[str], least: int = 3) -> Column:
    """Sorted distinct tokens without stopwords."""
    return F.array_sort(F.array_distinct(F.array_except(search_tokens(text, least), F.array(*(F.lit(w) for w in stopwords)).cast("array<string>"))))


def ngrams(tokens: Column, least: int = 2, most: int = 4, chars: int = 6) -> Column:
    """Distinct phrases of ``least`` to ``most`` neighbouring tokens with at least ``chars`` characters."""

    def runs(n: int) -> Column:  # by place, as a slice of a long array costs a copy of it
        return F.array_compact(F.transform(tokens, lambda x, i: F.concat(x, *(y for j in range(1, n) for y in (F.lit(" "), F.get(tokens, i + j))))))

    parts = [runs(n) for n in range(least, most + 1)]
    return F.array_distinct(F.filter(F.concat(*parts), lambda p: F.length(p) >= chars))


def term_in(term: Column, text: Column) -> Column:
    """Short terms as whole words, others anywhere."""
    whole = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower(term), F.lit(" ")))
    return F.when(F.length(term) < 5, whole).otherwise(F.lower(text).contains(F.lower(term)))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; the text itself if it has fewer than two."""
    return F.when(F.length(text) < 2, F.array(text)).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), 1)))


def dice(a: Column, b: Column) -> Column:
    """Similarity of two squeezed texts by their sets of letter pairs; 1 if equal, 0.98 if one holds the other."""
    x, y = bigrams(a), bigrams(b)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.98).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def line_type(description: Column) -> Column:
    """SERVICE, PACKAGING or GOODS."""
    text = F.coalesce(F.trim(description), F.lit(""))
    return F.when(text.rlike(any_of(SERVICE)), "SERVICE").when(text.rlike(any_of(PACKAGING)), "PACKAGING").otherwise("GOODS")


def is_metadata(description: Column) -> Column:
    text = F.coalesce(F.trim(description), F.lit(""))
    return (F.length(text) < 4) | text.rlike(any_of(METADATA))


def is_complete_vehicle(description: Column) -> Column:
    text = F.coalesce(F.trim(description), F.lit(""))
    return text.rlike(any_of(VEHICLE)) & ~text.rlike(f"(?i){VEHICLE_PART}")


def commercial_lines(corpus: Column) -> Column:
    """A text without its lines of metadata, services and packaging."""
    return F.array_join(F.filter(F.split(corpus, "\n"), lambda x: ~is_metadata(x) & (line_type(x) == "GOODS")), "\n")


def rewrite(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """Replaces phrases one after the other, longest first; later ones see what earlier ones put."""
    for phrase, put in sorted(phrases, key=lambda p: (-len(p[0]), p[0])):
        text = F.regexp_replace(text, rf"(?i)\b{phrase}\b", put)
    return text


def strip_quantity(description: Column) -> Column:
    """Without a leading count and counts of pieces or kilograms within."""
    x = F.regexp_replace(F.trim(description), r"^\s*\d+[\s,.]*", "")
    x = F.regexp_replace(x, r"(?i)\b\d+[\s,.]*(KOSOVA|KOSOV|KOS|KOM|KPLI|KPL|KG)\b", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s*;\s*", " "), r"\s+", " "), r"^[ ,;:\-]+|[ ,;:\-]+$", "")


def description_hash(description: Column) -> Column:
    return F.sha2(F.upper(F.trim(F.regexp_replace(description, r"\s+", " "))), 256)


def split_hierarchy(path: Column) -> tuple[Column, Column, Column]:
    """(chapter, heading, leaf) of a path joined by ``>``, lower case, empty where it is shorter."""
    parts = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda p: p != "")
    at = lambda i: F.lower(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")))
    return at(1), F.when(F.size(parts) >= 2, at(-2)).otherwise(""), at(-1)


def positions(text: Column) -> Column:
    """"3 and 8, 10-12" as [3, 8, 10, 11, 12], sorted."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\d{1,6}(?:\s*[-–]\s*\d{1,6})?)"), 1)
    spans = F.transform(tokens, lambda t: F.transform(F.split(t, r"\s*[-–]\s*"), lambda x: x.cast("int")))
    each = F.transform(spans, lambda s: F.sequence(F.element_at(s, 1), F.greatest(F.element_at(s, 1), F.element_at(s, -1))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def language_hint(text: Column) -> Column:
    """sl, de, hr or en by letters and marker words."""
    x = F.lower(text)
    return (
        F.when(x.rlike(r"[äöüß]|\b(?:und|für|mit)\b"), "de")
        .when(x.rlike(r"[ćđ]"), "hr")
        .when(x.rlike(r"[čšž]|\b(?:kos|za|iz|ali)\b"), "sl")
        .otherwise("en")
    )
