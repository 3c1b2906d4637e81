"""Attributes that texts name, and answers merged by who gave them.

Answers are maps from question to answer.  Sources stand in an order of precedence, each with a least confidence: a user's answers
hold whatever their confidence, automatic ones above a threshold, what a text shows only for questions that are open after that.
The merge keeps, for every question, which source won and which others said something else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Least confidence of automatic answers.  Fixed value.
AUTOMATIC = 0.82
#: Attribute, value, words that show it: the first that fits counts.  Fixed values.
SIGNS = [
    ("gender", "male", r"\b(?:men'?s?|male|boys?|moške|moška|moški)\b"), ("gender", "female", r"\b(?:women'?s?|female|girls?|ladies|ženske|ženska)\b"),
    *(("material", m, m) for m in ("cotton", "wool", "polyester", "silk", "linen", "nylon", "viscose")), ("material", "cotton", "bombaž"),
    ("fabric", "denim", "denim|jeans"), ("fabric", "jersey", "jersey"), ("fabric", "fleece", "fleece"),
    ("construction", "woven", r"\b(?:jeans|denim|trousers|pants|woven)\b"), ("construction", "knitted", r"\b(?:t-?shirt|polo|sweater|knitted|knit)\b"),
]
#: Question and answer that an attribute's value stands for.  Fixed values.
ANSWERS = [("construction", "woven", "textile_construction", "woven"), ("construction", "knitted", "textile_construction", "knitted"), ("gender", "male", "apparel_gender", "mens"), ("gender", "female", "apparel_gender", "womens")]


def _plain(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def detect(text: Column, stated: Column | None = None, signs: Sequence[tuple[str, str, str]] = SIGNS) -> Column:
    """A map of the attributes that a text shows; what is stated (a map) counts before it.  Nulls and blanks are nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for attribute in dict.fromkeys(a for a, _, _ in signs):
        shown = F.coalesce(*(F.when(low.rlike(p), v) for a, v, p in signs if a == attribute), F.lit(None).cast("string"))
        own = _plain(F.try_element_at(stated, F.lit(attribute))) if stated is not None else F.lit(None).cast("string")
        found.append(F.struct(F.lit(attribute).alias("key"), F.coalesce(own, shown).alias("value")))
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))


def answers(attributes: Column, table: Sequence[tuple[str, str, str, str]] = ANSWERS) -> Column:
    """The questions that attributes answer: (question, answer) of the table's rows that hold."""
    rows = F.array(*(F.struct(F.lit(q).alias("key"), F.when(F.try_element_at(attributes, F.lit(a)) == v, r).alias("value")) for a, v, q, r in table))
    held = F.filter(rows, lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.filter(held, lambda e, i: F.array_position(F.transform(held, lambda x: x["key"]), e["key"]) == i + 1))


@dataclass(frozen=True)
class Source:
    """Answers of one source, how sure it is, and from which confidence on it counts (always, if None)."""

    name: str
    answers: Column
    confidence: Column | None = None
    least: float | None = None


def _beside(name: str):
    """How a source's answer joins what won so far."""

    def joined(_: Column, won: Column, new: Column) -> Column:
        first = F.struct(new.alias("answer"), F.lit(name).alias("source"), F.array().cast("array<string>").alias("against"))
        other = F.struct(won["answer"].alias("answer"), won["source"].alias("source"), F.concat(won["against"], F.array(F.lit(name))).alias("against"))
        return F.when(won.isNull(), first).when(new.isNull() | (new == won["answer"]), won).otherwise(other)

    return joined


def merge(sources: Sequence[Source]) -> Column:
    """A map from question to (answer, source, against): the first source in order that counts, and sources that gave another answer.

    Blank and null answers are none; a null map or confidence is a source that says nothing."""
    out = F.expr("CAST(map() AS map<string, struct<answer: string, source: string, against: array<string>>>)")
    for s in sources:
        given = F.coalesce(s.answers, F.expr("CAST(map() AS map<string, string>)"))
        if s.least is not None:
            given = F.when(F.coalesce(s.confidence, F.lit(0.0)) >= s.least, given).otherwise(F.expr("CAST(map() AS map<string, string>)"))
        given = F.map_filter(given, lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False)))

        out = F.map_zip_with(out, given, _beside(s.name))
    return out


def by_source(merged: Column, source: str) -> Column:
    """The questions that a source answered, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(merged, lambda _, v: v["source"] == source)))
