"""Repair of texts whose fonts lost letters: control signs stand for letters, by a substitution that each source has for itself.

Tokens with signs are aligned with a list of words of equal pattern: both with their signs, and the letters that may be broken, masked,
so that one equi-join finds all words that a token may be.  An alignment says which letter each sign would be.  A token has a vote, less the
fewer of its letters are sure, and shares it among its alignments.  Votes are added up by source and the alignments to choose from before a source is
settled, so that repeated tokens don't matter.  Settling propagates: the claim with most votes among those that contradict nothing fixed is fixed,
alignments that contradict it fall, their tokens' votes go to the rest, and all is counted again.  A claim needs ``LEAST`` votes, and against each other letter of
its sign ``MARGIN`` times the votes: those of tokens that may have the one and not the other, as tokens that may have both tell nothing.  A sign
may also stand for nothing (a soft hyphen, say): tokens that fit no word are aligned without it.  Known maps (``known``) are fixed from the start.

Words not in the list are repaired as well, as the map holds for the whole source.  A letter is a capital at the start of a token if
most aligned words say so for the sign, and in a token of at least three capitals and no small letter.  What no vote settles stays as it is and is reported.

Defined cases.  Null and empty texts, and texts without signs, stay as they are.  A null source is a source.  Repeated rows vote each
time.  White space among control characters is no sign.  Empty tables give no rows and no maps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Signs that stand for letters: control characters that are no white space.
SIGNS = "".join(map(chr, [*range(1, 9), *range(14, 28)]))
#: Letters that fonts lose.  Fixed values.
LOST = "čćšžđ"
LEAST, MARGIN = 1.0, 1.5
#: Letters of a word that no font loses, at least.
PLAIN = 2
_SIGN, _MASK = f"[{SIGNS[0]}-{SIGNS[7]}{SIGNS[8]}-{SIGNS[-1]}]", "?"


def has_signs(text: Column) -> Column:
    return F.coalesce(text.rlike(_SIGN), F.lit(False))


def _core(token: Column) -> Column:
    """A token's letters and signs."""
    return F.regexp_replace(token, rf"[^\p{{L}}{SIGNS[:8]}{SIGNS[8:]}]", "")


def _masked(text: Column, letters: str) -> Column:
    return F.translate(text, SIGNS + letters, _MASK * (len(SIGNS) + len(letters)))


def alignments(texts: DataFrame, words: DataFrame, letters: str = LOST) -> DataFrame:
    """(source, choices, votes): what tokens of texts (source, text) may be, each choice with its claims (sign, letter; '' is nothing), added up.

    A choice's ``initial`` is its sign at a token's start with whether the word begins with a capital there."""
    low = letters.lower()
    known = words.select(F.col("word").alias("own")).where(F.length("own") > 1).distinct()
    known = known.select("own", F.lower("own").alias("word")).where(F.length("own") == F.length("word")).withColumn("key", _masked(F.col("word"), low))
    broken = texts.where(has_signs(F.col("text"))).select("source", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("token")).where(has_signs(F.col("token")))
    tokens = broken.select("source", _core(F.col("token")).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))
    signs = F.array_distinct(F.regexp_extract_all("token", F.lit(f"({_SIGN})"), 1))
    gone = F.concat(F.array(F.lit("")), signs)
    tried = tokens.withColumn("gone", F.explode(gone)).withColumn("left", F.when(F.col("gone") == "", F.lower("token")).otherwise(F.lower(F.expr("replace(token, gone, '')")))).withColumn("key", _masked(F.col("left"), low))
    met = tried.join(known, "key")
    at = F.sequence(F.lit(1), F.length("left"))
    pairs = F.filter(F.transform(at, lambda i: F.struct(F.substr("left", i, F.lit(1)).alias("sign"), F.substr("word", i, F.lit(1)).alias("letter"))), lambda p: p["sign"] != p["letter"])
    claims = F.array_sort(F.array_distinct(F.concat(pairs, F.when(F.col("gone") != "", F.array(F.struct(F.col("gone").alias("sign"), F.lit("").alias("letter")))).otherwise(F.array().cast("array<struct<sign: string, letter: string>>")))))
    met = met.withColumn("claims", claims)
    one_each = F.size(F.array_distinct(F.transform("claims", lambda p: p["sign"]))) == F.size("claims")
    sound = F.forall("claims", lambda p: p["sign"].rlike(_SIGN) & ((p["letter"] == "") | F.lit(low).contains(p["letter"])))
    plain = F.length(F.regexp_replace("key", rf"\{_MASK}", ""))
    met = met.withColumn("plain", plain).where(one_each & sound & (F.size("claims") > 0) & (F.col("plain") >= PLAIN))
    initial = F.when(F.substring("left", 1, 1).rlike(_SIGN), F.struct(F.substring("left", 1, 1).alias("sign"), (F.lower(F.substring("own", 1, 1)) != F.substring("own", 1, 1)).alias("capital")))
    met = met.groupBy("source", "token", "n", "claims", (F.col("gone") != "").alias("less")).agg(F.min(initial).alias("initial"), F.max("plain").alias("plain"))
    # a token is read without a sign only if no word fits it with one
    choice = F.struct("claims", "initial")
    each = met.groupBy("source", "token", "n").agg(F.collect_list(F.when(~F.col("less"), choice)).alias("full"), F.collect_list(F.when(F.col("less"), choice)).alias("short"), F.max("plain").alias("plain"))
    choices = F.array_sort(F.when(F.size("full") > 0, F.col("full")).otherwise(F.col("short")))
    return each.select("source", choices.alias("choices"), (F.col("n") * F.least("plain", F.lit(6)) / 6).alias("votes")).groupBy("source", "choices").agg(F.sum("votes").alias("votes"))


Claims = list[tuple[str, str]] | tuple[tuple[str, str], ...]


def settle(sets: Iterable[tuple[Claims, float]], known: dict[str, str]) -> dict[str, tuple[str, float]]:
    """The same as ``settle_choices`` for tokens that may be one thing only."""
    return settle_choices((([claims], votes) for claims, votes in sets), known)


def settle_choices(tokens: Iterable[tuple[list[Claims], float]], known: dict[str, str]) -> dict[str, tuple[str, float]]:
    """Letter and votes of each sign that is settled: known ones first, then the strongest claims one after another."""
    fixed = {s: (c, 0.0) for s, c in known.items()}
    tokens = [(choices, votes) for choices, votes in tokens if votes > 0]
    lettered = {s for choices, _ in tokens for claims in choices for s, c in claims if c}
    for nothing in (False, True):  # that a sign is nothing counts only if no word fits it as a letter
        rest = [([claims for claims in choices if nothing or all(c for _, c in claims)], votes) for choices, votes in tokens]
        while True:
            taken = {c: s for s, (c, _) in fixed.items() if c}
            rest = [([claims for claims in choices if all((s not in fixed or fixed[s][0] == c) and taken.get(c, s) == s for s, c in claims)], votes) for choices, votes in rest]
            rest = [(choices, votes) for choices, votes in rest if choices]
            count: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
            may: dict[str, dict[frozenset[str], float]] = defaultdict(lambda: defaultdict(float))  # votes by the letters that a token leaves open for a sign
            for choices, votes in rest:
                open_: dict[str, set[str]] = defaultdict(set)
                for claims in choices:
                    for s, c in claims:
                        if s not in fixed and (c or s not in lettered):
                            count[s][c] += votes / len(choices)
                            open_[s].add(c)
                for s, letters in open_.items():
                    may[s][frozenset(letters)] += votes
            best = None
            for s in sorted(count):
                c, votes = min(count[s].items(), key=lambda x: (-x[1], x[0]))
                only = lambda a, b: sum(v for letters, v in may[s].items() if a in letters and b not in letters)  # noqa: B023, E731
                if votes >= LEAST and (best is None or votes > best[2]) and all((mine := only(c, d)) >= MARGIN * only(d, c) and mine > 0 for d in count[s] if d != c):
                    best = (s, c, votes)
            if best is None:
                break
            fixed[best[0]] = (best[1], best[2])
    return fixed


def maps(texts: DataFrame, words: DataFrame, known: DataFrame | None = None, letters: str = LOST) -> DataFrame:
    """(source, sign, letter, votes, capital): what each source's signs stand for; ``known`` (source, sign, letter) is taken as it is."""
    kind = dict(texts.dtypes)["source"]
    found = alignments(texts, words, letters)
    if known is not None:
        own = known.groupBy("source").agg(F.collect_set(F.struct("sign", "letter")).alias("claims"))
        choice = F.struct("claims", F.lit(None).cast("struct<sign: string, capital: boolean>").alias("initial"))
        found = found.unionByName(own.select("source", F.array(choice).alias("choices"), F.lit(-1.0).alias("votes")))
    # null sources make a group of their own
    return found.groupBy("source").applyInPandas(_settled, f"source {kind}, sign string, letter string, votes double, capital boolean")


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    tokens: dict[tuple, float] = defaultdict(float)
    known: dict[str, str] = {}
    capitals: dict[str, float] = defaultdict(float)
    for choices, votes in zip(rows["choices"], rows["votes"], strict=True):
        each = tuple(tuple((p["sign"], p["letter"]) for p in choice["claims"]) for choice in choices)
        if votes < 0:
            known.update(sorted(each[0]))
            continue
        tokens[each] += votes
        for at in (choice["initial"] for choice in choices):
            if at is not None:
                capitals[at["sign"]] += (votes if at["capital"] else -votes) / len(choices)
    done = settle_choices(sorted(tokens.items()), known)
    source = rows["source"].iloc[0]
    return pd.DataFrame([(source, s, c, v, capitals.get(s, 0.0) > 0) for s, (c, v) in sorted(done.items())], columns=["source", "sign", "letter", "votes", "capital"])


def repaired(texts: DataFrame, by: DataFrame) -> DataFrame:
    """The rows (source, text and others) with the text put right by the maps, and ``signs`` and ``unknown``: which signs it had and still has."""
    order = F.array_sort(F.collect_list(F.struct((F.col("letter") == "").alias("none"), "sign", "letter", "capital")))  # translate drops what has no counterpart: those come last
    each = by.groupBy("source").agg(order.alias("m"))
    joined = lambda f: F.array_join(F.transform("m", f), "")
    each = each.select(
        F.col("source").alias("_source"), joined(lambda p: p["sign"]).alias("_from"), joined(lambda p: p["letter"]).alias("_to"),
        joined(lambda p: F.when(p["capital"], F.upper(p["letter"])).otherwise(p["letter"])).alias("_first"), joined(lambda p: F.upper(p["letter"])).alias("_upper"),
    )
    rows = texts.join(each, F.col("source").eqNullSafe(F.col("_source")), "left")
    into = lambda x, to: F.call_function("translate", x, F.col("_from"), F.col(to))
    capitals = lambda t: t.rlike(r"\p{Lu}.*\p{Lu}.*\p{Lu}") & ~t.rlike(r"\p{Ll}")
    token = lambda t: F.when(capitals(t), into(t, "_upper")).otherwise(F.concat(into(F.substring(t, 1, 1), "_first"), into(F.substr(t, F.lit(2)), "_to")))
    fixed = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)(\s+|\S+)"), 1), token), "")
    signs = lambda x: F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(f"({_SIGN})"), 1)))
    out = rows.withColumn("_fixed", F.when(has_signs(F.col("text")) & F.col("_from").isNotNull(), fixed).otherwise(F.col("text")))
    out = out.withColumns({"signs": signs(F.coalesce("text", F.lit(""))), "unknown": signs(F.coalesce("_fixed", F.lit("")))})
    return out.withColumn("text", F.col("_fixed")).drop("_source", "_from", "_to", "_first", "_upper", "_fixed")


def unknown_signs(rows: DataFrame, around: int = 12) -> DataFrame:
    """(source, sign, rows, sample): signs that repaired rows still have, in how many, and the least of their surroundings."""
    each = rows.select("source", "text", F.explode("unknown").alias("sign"))
    place = F.expr("instr(text, sign)")
    near = F.substr("text", F.greatest(F.lit(1), place - around), F.lit(2 * around + 1))
    return each.withColumn("near", near).groupBy("source", "sign").agg(F.count("*").alias("rows"), F.min("near").alias("sample"))
