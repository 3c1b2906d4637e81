"""Shipment facts in texts: weights, packages, pallets and dimensions, by assigning values to labels.

All labels and all values of a text are found once, with their places.  A value may belong to a label of its kind that stands in its
line before it, or after it where the label is a package word (``35 cartons``), or in the line above.  Pairs are taken from the
nearest on, each label and each value once: in a line the gap between them counts, from the line above the shift of their columns,
behind all pairs of one line.  So a line of two columns, a line of labels over a line of values, and labels of several languages
for one value need no pattern of their own.

A pair looks at ``REACH`` characters at most, so that the work grows with a text's length.  Of several pairs of a field the first in
the text counts.  Weights are converted to kilograms, dimensions to centimetres.  Null and empty texts have no facts; every row is a text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

REACH = 80
#: Labels by field, in several languages.  Fixed values.
LABELS = {
    "gross": r"gross\s*weight|grossweight|total\s+gross|gross|bruto\s+te[žz]a|bruttogewicht|poids\s+brut|peso\s+bruto|peso\s+lordo|brutto|bruto|btto",
    "net": r"net\s*weight|netweight|total\s+net|weight\s+net|netto\s+weight|neto\s+te[žz]a|nettogewicht|poids\s+net|peso\s+neto|peso\s+netto|netto|neto|nett|ntto|net",
    "tare": r"tare|tara",
    "dimensions": r"pallet\s+dimensions?|paleta\s+dimenzije|dimenzij[ae]|dimensions?|abmessungen|ma(?:ß|ss)e",
    "packages": r"skupaj\s+število|število\s+koli|number\s+of\s+packages?|packages?|kosov|koli|collis?|cartons?|ctns?|box(?:es)?|pkgs?|kartons?",
    "pallets": r"pallet\(s\)|pallets?|pallete?s?|palet(?:ten|te|a|e|i)?",
}
#: Package words that may follow their number, with the code they stand for.  Fixed values.
AFTER = {"packages": r"koli|collis?|cartons?|ctns?|box(?:es)?|pkgs?|kartons?", "pallets": LABELS["pallets"]}
CODES = [("CT", r"cartons?|ctns?|box(?:es)?|pkgs?|kartons?"), ("COLLI", r"koli|collis?")]
#: Kilograms of a unit, and centimetres.  Fixed values.
KILOGRAMS = {"kg": 1.0, "kgs": 1.0, "g": 0.001, "lb": 0.45359237, "lbs": 0.45359237, "t": 1000.0, "ton": 1000.0, "tonne": 1000.0, "tons": 1000.0, "tonnes": 1000.0}
CENTIMETRES = {"mm": 0.1, "cm": 1.0, "m": 100.0}

_LABEL = re.compile("|".join(rf"(?P<{k}>(?<!\w)(?:{p})(?!\w))" for k, p in LABELS.items()), re.I)
_UNIT = "|".join(sorted(KILOGRAMS, key=len, reverse=True))
_VALUE = re.compile(
    r"(?P<dims>(?<![\w.,])\d+(?:[.,]\d+)?\s*[x×]\s*\d+(?:[.,]\d+)?\s*[x×]\s*\d+(?:[.,]\d+)?(?:\s*(?P<length>mm|cm|m)(?!\w))?)"
    rf"|(?P<before>(?<!\w)(?:{_UNIT})[ \t]+)?(?P<number>(?<![\w.,])\d+(?:[.,]\d+)*)(?:[ \t]*(?P<unit>{_UNIT})(?!\w))?(?![\w]|[.,]\d)", re.I,
)
_COLUMNS = 1 << 20  # lies behind every gap within a line


def number(text: str) -> float:
    """A point or a comma before at most three last digits is decimal; else points separate thousands and a comma is decimal."""
    if re.fullmatch(r"\d+[.,]\d{1,3}", text):
        return float(text.replace(",", "."))
    whole, _, part = text.replace(".", "").partition(",")
    return float(f"{whole}.{part.replace(',', '') or 0}")


def _values(text: str) -> list[tuple[int, int, str, object]]:
    """(start, end, kind, value) of the values: weight (kilograms), plain (a number without unit), dims (centimetres)."""
    out = []
    for m in _VALUE.finditer(text):
        if m["dims"]:
            by = CENTIMETRES[(m["length"] or "cm").lower()]
            out.append((m.start(), m.end(), "dims", tuple(round(float(x.replace(",", ".")) * by, 3) for x in re.findall(r"\d+(?:[.,]\d+)?", m["dims"])[:3])))
        elif unit := (m["unit"] or (m["before"] or "").strip()).lower():
            out.append((m.start(), m.end(), "weight", number(m["number"]) * KILOGRAMS[unit]))
        else:
            out.append((m.start(), m.end(), "plain", number(m["number"])))
    return out


_SUITS = {"gross": ("weight", "plain"), "net": ("weight", "plain"), "tare": ("weight", "plain"), "dimensions": ("dims",), "packages": ("plain",), "pallets": ("plain",)}


def assigned(text: str) -> list[tuple[str, str, object]]:
    """(field, label, value) of the pairs of a text, by the label's place."""
    values = _values(text)
    taken = [(a, b) for a, b, _, _ in values]
    labels = [(m.start(), m.end(), m.lastgroup, m[0].lower()) for m in _LABEL.finditer(text)]
    labels = [x for x in labels if not any(a <= x[0] < b for a, b in taken[max(0, bisect_left(taken, (x[0],)) - 1) : bisect_left(taken, (x[0],)) + 1])]
    begins, pairs = [a for a, *_ in values], []
    for i, (start, end, field, word) in enumerate(labels):
        line = text.rfind("\n", 0, start) + 1
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        for j in range(bisect_left(begins, max(line, start - REACH)), bisect_left(begins, min(stop, end + REACH))):
            a, b, kind, value = values[j]
            if kind not in _SUITS[field] or field in ("packages", "pallets") and value != int(value):
                continue
            if a >= end:
                pairs.append((a - end, i, j))
            elif b <= start and field in AFTER and re.fullmatch(AFTER[field], word, re.I) and not text[b:start].strip(" \tx×"):
                pairs.append((start - b, i, j))
        if field not in AFTER and stop < len(text):  # the line below
            below = text.find("\n", stop + 1)
            below = len(text) if below < 0 else below
            column = start - line
            for j in range(bisect_left(begins, max(stop + 1, stop + 1 + column - REACH)), bisect_left(begins, min(below, stop + 1 + column + REACH))):
                a, _, kind, _ = values[j]
                if kind in _SUITS[field]:
                    pairs.append((_COLUMNS + abs(a - stop - 1 - column), i, j))
    mine: dict[int, int] = {}
    used: set[int] = set()
    for _, i, j in sorted(pairs):
        if i not in mine and j not in used:
            mine[i] = j
            used.add(j)
    return [(labels[i][2], labels[i][3], values[j][3]) for i, j in sorted(mine.items())]


def _facts(text: str | None) -> tuple[float | None, float | None, float | None, int | None, str | None, int | None, str | None]:
    first: dict[str, tuple[str, object]] = {}
    for field, word, value in assigned(text) if text else ():
        first.setdefault(field, (word, value))
    weight = lambda f: round(first[f][1], 6) if f in first else None
    count = lambda f: int(first[f][1]) if f in first else None
    code = next((c for c, p in CODES if re.fullmatch(p, first["packages"][0])), "COLLI") if "packages" in first else "PALLET" if "pallets" in first else None
    dims = "x".join(f"{x:g}" for x in first["dimensions"][1]) + " cm" if "dimensions" in first else None
    return weight("gross"), weight("net"), weight("tare"), count("packages"), code, count("pallets"), dims


COLUMNS = "gross_kg double, net_kg double, tare_kg double, packages bigint, package_type string, pallets bigint, dimensions string"


def summaries(texts: DataFrame) -> DataFrame:
    """id and the facts of every text (id, text): weights in kilograms, packages with their code, pallets, dimensions of a pallet."""
    kind = dict(texts.dtypes)["id"]
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    types = [pa.float64()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_facts(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["id", *names])

    return texts.select("id", "text").mapInArrow(read, f"id {kind}, {COLUMNS}")
