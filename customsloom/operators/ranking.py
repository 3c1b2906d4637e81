"""Ranking of tariff candidates: weighted terms by layer, hints, bonuses, confidence by rank, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from customsloom.functions.numbers import round_up

#: Weights of the layers that a term may match, bonuses of hints, least score.  Fixed values.
LAYERS = {"cn8": 3.0, "heading": 2.2, "chapter": 1.4}
CHAPTER_HINT, HEADING_HINT, FLOOR = 4.0, 5.0, 2.0
#: Weight from which a term counts as a focus term; what a confidence gains if the heading is hinted.  Fixed values.
FOCUS, PRIOR = 1.0, 0.12
#: If a query has all of the first terms, a candidate without any of the second keeps MISSING_CO of its score.  Fixed values.
CO_TERMS = [
    (("ball", "bearing"), ("ball", "bearing", "bearings", "roller")),
    (("ball", "bearings"), ("ball", "bearing", "bearings", "roller")),
    (("pellet", "rifle"), ("cartridge", "cartridges", "ammunition", "shot", "projectile", "9306")),
    (("pellets", "rifle"), ("cartridge", "cartridges", "ammunition", "shot", "projectile", "9306")),
    (("air", "pellet"), ("cartridge", "cartridges", "ammunition", "9306", "9304")),
    (("air", "pellets"), ("cartridge", "cartridges", "ammunition", "9306", "9304")),
]
MISSING_CO = 0.15
#: Shares of the base score that bonuses add at most.  Fixed values.
KNOWLEDGE, BRAND, VALIDATION, HEADING_ONLY = 0.20, 0.10, 0.18, 0.2
#: Sets of terms up to which they are sent to all tasks.
FEW_SETS = 1 << 14


def weighted_terms(phrases: DataFrame) -> DataFrame:
    """(query_id, term, weight) from rows with an ``ord``: of one term the first counts."""
    rank = F.row_number().over(Window.partitionBy("query_id", "term").orderBy("ord"))
    return phrases.withColumn("_r", rank).where("_r = 1").select("query_id", "term", "weight")


def term_sets(terms: DataFrame, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, set_id, focus) of each query, and (set_id, asked: array of term and weight, hints: all that queries of the set have).

    A set's id is a 64-bit hash of its terms and weights.
    """
    asked = F.array_sort(F.collect_list(F.struct("term", F.col("weight").cast("double").alias("weight"))))
    own = terms.groupBy("query_id").agg(asked.alias("asked"), F.count_if(F.col("weight") >= FOCUS).cast("int").alias("focus"))
    own = own.withColumn("set_id", F.xxhash64("asked"))
    if hints is None:
        return own.select("query_id", "set_id", "focus"), own.groupBy("set_id").agg(F.first("asked").alias("asked")).withColumn("hints", F.array().cast("array<string>"))
    named = own.join(hints.select("query_id", "hint").distinct(), "query_id", "left")
    return own.select("query_id", "set_id", "focus"), named.groupBy("set_id").agg(F.first("asked").alias("asked"), F.collect_set("hint").alias("hints"))


def with_co_match(scored: DataFrame, sets: DataFrame, words: DataFrame, rules: list[tuple[tuple[str, ...], tuple[str, ...]]] = CO_TERMS) -> DataFrame:
    """Scores (set_id, cn8, score) times MISSING_CO for each list of wanted words that the set's terms call for and the candidate has none of."""
    named = lambda xs: F.array(*(F.lit(x) for x in xs))
    wanted = list(dict.fromkeys(w for _, w in rules))
    calls = [F.when(F.size(F.array_except(named(when), F.col("asked.term"))) == 0, F.lit(wanted.index(w))) for when, w in rules]
    called = sets.select("set_id", F.array_distinct(F.array_compact(F.array(*calls))).alias("called")).where(F.size("called") > 0)
    has = [F.when(F.col("term").isin(list(w)), F.lit(i)) for i, w in enumerate(wanted)]
    held = words.select("cn8", F.explode(F.array_compact(F.array(*has))).alias("i")).groupBy("cn8").agg(F.collect_set("i").alias("has"))
    missing = F.size(F.array_except("called", F.coalesce("has", F.array().cast("array<int>"))))
    factor = F.when(F.col("called").isNotNull(), F.pow(F.lit(MISSING_CO), missing)).otherwise(1.0)
    return scored.join(called, "set_id", "left").join(held, "cn8", "left").withColumn("score", round_up(F.col("score") * factor, 6)).drop("called", "has")


def best(terms: DataFrame, words: DataFrame, hints: DataFrame | None, keep: int) -> DataFrame:
    """(query_id, cn8, score, terms, focus, prior) of the ``keep`` best candidates of each query with a score of at least FLOOR.

    terms: (query_id, term, weight); words: (cn8, layer, term); hints: (query_id, hint), a hint being a chapter or a heading.
    A term counts by the weight of its best layer; a hinted chapter adds 4 and a hinted heading 5 points.

    Queries of equal terms are scored once: a set of terms meets codes at equal terms, and codes are dealt out by their number, so
    that pairs are summed where they arise.  A hint lifts all codes of its chapter or heading alike: what is among the best
    of a query is among the best of its set of terms, at large or within a hinted chapter or heading.  So only ``keep`` codes of
    each of these leave the map side (a window that Spark limits before the exchange).
    """
    layer = F.when(F.col("layer") == "cn8", LAYERS["cn8"]).when(F.col("layer") == "heading", LAYERS["heading"]).otherwise(LAYERS["chapter"])
    factors = words.groupBy("cn8", "term").agg(F.max(layer).alias("factor"))
    codes = factors.repartition(2 * words.sparkSession.sparkContext.defaultParallelism, "cn8")  # few bytes, much work
    queries, sets = term_sets(terms, hints)
    sets = sets.persist()
    # codes then stay where they are dealt, and no pair of a set and a code is shuffled
    to_all = F.broadcast if sets.limit(FEW_SETS + 1).count() <= FEW_SETS else lambda rows: rows
    asked = to_all(sets.select("set_id", F.inline("asked")))
    scored = codes.join(asked, "term").groupBy("set_id", "cn8").agg(round_up(F.sum(F.col("weight") * F.col("factor")), 6).alias("score"), F.count("*").alias("terms"))
    scored = with_co_match(scored, sets, words)
    if hints is None:
        each = scored.where(F.col("score") >= FLOOR).withColumn("space", F.lit(""))
    else:
        spaces = F.concat(F.array(F.lit("")), F.array_intersect(F.array(F.substring("cn8", 1, 2), F.substring("cn8", 1, 4)), F.col("hints")))
        # at large only what reaches the floor by itself; hinted codes may reach it by their hint
        each = scored.join(to_all(sets.select("set_id", "hints")), "set_id").select("set_id", "cn8", "score", "terms", F.explode(spaces).alias("space")).where((F.col("space") != "") | (F.col("score") >= FLOOR))
    top = each.withColumn("k", F.row_number().over(Window.partitionBy("set_id", "space").orderBy(F.desc("score"), "cn8"))).where(F.col("k") <= keep).drop("k")
    if hints is None:
        met = queries.join(top, "set_id").select("query_id", "cn8", "score", "terms", "focus").withColumn("prior", F.lit(False))
    else:
        own = queries.select("query_id", "set_id", "focus", F.lit("").alias("space")).unionAll(queries.join(hints.select("query_id", "hint").distinct(), "query_id").select("query_id", "set_id", "focus", "hint"))
        met = own.join(top, ["set_id", "space"]).select("query_id", "cn8", "score", "terms", "focus").distinct()
        met = hinted(met, hints, prior=True)
    rank_ = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cn8"))
    return met.where(F.col("score") >= FLOOR).withColumn("k", rank_).where(F.col("k") <= keep).drop("k")


def hinted(scores: DataFrame, hints: DataFrame, prior: bool = False) -> DataFrame:
    """Adds 4 for a chapter and 5 for a heading that the query's hints (query_id, hint) name; ``prior`` adds whether a heading does."""
    own = hints.groupBy("query_id").agg(F.collect_set("hint").alias("_hints"))
    out = scores.join(own, "query_id", "left")
    chapter, heading = (F.coalesce(F.array_contains("_hints", F.substring("cn8", 1, n)), F.lit(False)) for n in (2, 4))
    out = out.withColumn("score", F.col("score") + F.when(chapter, CHAPTER_HINT).otherwise(0.0) + F.when(heading, HEADING_HINT).otherwise(0.0))
    return (out.withColumn("prior", heading) if prior else out).drop("_hints")


def penalised(score: Column, rules: list[tuple[Column, float]]) -> Column:
    """Multiplies by the factor of each rule that holds, in order."""
    return tuned(score, [(rule, "times", factor) for rule, factor in rules])


def tuned(score: Column, steps: list[tuple[Column, str, float]]) -> Column:
    """Adds or multiplies step by step; order matters.  One fold over the steps, which grows with their number alone."""
    if not steps:
        return score
    each = F.array(*(F.struct(F.coalesce(rule, F.lit(False)).alias("holds"), F.lit(1.0 if kind == "add" else float(value)).alias("times"), F.lit(float(value) if kind == "add" else 0.0).alias("plus")) for rule, kind, value in steps))
    return F.aggregate(F.filter(each, lambda s: s["holds"]), score.cast("double"), lambda x, s: x * s["times"] + s["plus"])


def universal_layers(family: Column, heading: Column, chapter: Column, keyword: Column) -> Column:
    """50, 30, 20 and 10 points for what matches."""
    return sum((F.when(c, float(w)).otherwise(0.0) for c, w in ((family, 50), (heading, 30), (chapter, 20), (keyword, 10))), F.lit(0.0))


def validation(ranked: DataFrame, strong: DataFrame) -> DataFrame:
    """Adds 0.18 times confidence of the score for an exact code among ``strong`` (query_id, cn8, heading, confidence); a fifth of that for a heading if no candidate of the query is exact."""
    exact = strong.groupBy("query_id", "cn8").agg(F.max("confidence").alias("_exact"))
    heading = strong.groupBy("query_id", F.col("heading").alias("_heading")).agg(F.max("confidence").alias("_near"))
    out = ranked.withColumn("_heading", F.substring("cn8", 1, 4)).join(exact, ["query_id", "cn8"], "left").join(heading, ["query_id", "_heading"], "left")
    any_exact = F.max(F.col("_exact").isNotNull()).over(Window.partitionBy("query_id"))
    bonus = F.when(F.col("_exact").isNotNull(), F.col("score") * VALIDATION * F.col("_exact")).when(~any_exact & F.col("_near").isNotNull(), F.col("score") * VALIDATION * F.col("_near") * HEADING_ONLY).otherwise(0.0)
    return out.withColumn("validation_bonus", bonus).withColumn("score", F.col("score") + F.col("validation_bonus")).drop("_exact", "_near", "_heading")


def confidence(score: Column, best: Column, focus: Column, rank: Column, prior: Column | None = None) -> Column:
    """From the share of the best score, of four focus terms of the query and a hinted heading, between 0.38 and 0.97, falling with the rank (from 0)."""
    relative = score / best
    combined = 0.55 * relative + 0.33 * F.least(F.lit(1.0), focus / 4.0) + (F.lit(0.0) if prior is None else F.when(prior, PRIOR).otherwise(0.0))
    base = F.least(F.lit(0.97), F.greatest(F.lit(0.38), combined * 0.94))
    decay = F.greatest(F.lit(0.78), 1.0 - 0.11 * rank)
    decay = F.when(relative > 0.95, F.greatest(F.lit(0.72), decay - 0.05)).otherwise(decay)
    return F.when(best <= 0, 0.35).otherwise(round_up(F.when(rank > 0, base * decay).otherwise(base), 2))


def capped(raw: Column, quality: Column, rank: Column) -> Column:
    ceiling = F.when(quality < 0.4, 0.45).when(quality < 0.55, 0.65).when(quality < 0.7, 0.82).otherwise(0.97)
    return F.least(raw, F.when(rank > 0, F.greatest(F.lit(0.38), ceiling - 0.06 * rank)).otherwise(ceiling))


def rank(scores: DataFrame, limit: int, quality: float = 1.0) -> DataFrame:
    """The best of each query (columns of ``best``, which should have kept one more than limit) with a score of at least 2: rank from 0, confidence, capped confidence, and the query's state by top score and margin."""
    query = Window.partitionBy("query_id")
    order = query.orderBy(F.desc("score"), "cn8")
    out = scores.where(F.col("score") >= FLOOR).withColumns({"rank": F.row_number().over(order) - 1, "_best": F.max("score").over(query), "_next": F.lead("score").over(order)}).where(F.col("rank") < limit)
    out = out.withColumn("confidence", confidence(F.col("score"), F.col("_best"), F.col("focus"), F.col("rank"), F.col("prior"))).withColumn("capped", capped(F.col("confidence"), F.lit(quality), F.col("rank")))
    narrow = (F.col("_next").isNotNull()) & ((F.col("score") - F.col("_next")) / F.col("score") < 0.05) & (F.col("capped") < 0.75)
    state = F.when(F.lit(quality < 0.35), "ABSTAIN").when((F.col("capped") < 0.55) | narrow, "EXPERT_REQUIRED").otherwise("SUGGEST")
    return out.withColumn("state", F.when(F.col("rank") == 0, state)).drop("_best", "_next")


def bonus(score: Column, share: float, conf: Column) -> Column:
    """Part of a positive base score."""
    return F.when(score > 0, score * share * F.coalesce(conf, F.lit(0.0))).otherwise(0.0)
