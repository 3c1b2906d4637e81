"""Retrieval, evidence, ranking and mining over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.operators import mining, ranking, search
from customsloom.plans.bindings import DECLARATIONS, code_of, declarations, table
from customsloom.plans.registry import ORACLES, query
from customsloom.sources.shared import stored


def _r(x: str, n: int) -> str:
    return f"floor(({x}) * {10**n} + 0.5) / {10**n}"


_TOKENS = "list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= {n})"

_HITS = f"""{DECLARATIONS}, d AS (SELECT id, {_TOKENS.format(x='description', n=4)} AS w FROM declarations), st AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM d),
  q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS.format(x='text', n=4)}) AS term FROM benchmark), u AS (SELECT DISTINCT term FROM q),
  p AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM d) JOIN u USING (term) GROUP BY 1, 2, 3),
  f AS (SELECT term, count(*) AS n FROM p GROUP BY 1), k AS (SELECT term, mean, greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) AS idf FROM f, st),
  s AS (SELECT query_id, id, {_r('sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))', 6)} AS score FROM q JOIN p USING (term) JOIN k USING (term) GROUP BY 1, 2),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 100)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(asked, declarations(spark, sf_dir), "id", "description", 100)


@query(f"WITH {_HITS} SELECT query_id, id, {_r('score', 3)} AS score FROM hits WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions.numbers import round_up

    return _hits(spark, sf_dir).where("rank <= 10").select("query_id", "id", round_up(F.col("score"), 3).alias("score"))


_FOUND = f"""{_HITS}, e AS (SELECT query_id, cn8, heading, sum(weight) AS w, count(*) AS hits, sum(abs(score) * weight) AS rs, sum(CASE WHEN country = 'EN' THEN weight ELSE 0.0::DOUBLE END) AS home FROM hits JOIN declarations USING (id) GROUP BY 1, 2, 3),
  x AS (SELECT *, sum(w) OVER (PARTITION BY query_id) AS wa, sum(w) OVER (PARTITION BY query_id, heading) AS wh, max(rs) OVER (PARTITION BY query_id) AS rb FROM e),
  found0 AS (SELECT query_id, cn8, heading, hits, CAST(greatest(1, floor(w + 0.5)) AS BIGINT) AS match_count, {_r('least(0.99, 0.35 * w / wa + 0.35 * wh / wa + 0.15 * rs / rb + 0.15 * least(1.0, w / 25) + CASE WHEN w > 20 THEN 0.08 ELSE 0.0 END)', 4)} AS confidence,
    {_r('rs / rb', 4)} AS similarity, {_r('home / w', 4)} AS country_match FROM x),
  found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_count DESC, confidence DESC, cn8) AS rank FROM found0) WHERE rank <= 5)"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with what their declarations say; the hits are of known size, so that few don't shuffle all declarations."""
    return stored(_hits(spark, sf_dir), "hits").join(declarations(spark, sf_dir).select("id", "cn8", "heading", "weight", "country"), "id")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.evidence(_told(spark, sf_dir), "EN")


@query(f"WITH {_FOUND} SELECT query_id, cn8, heading, hits, match_count, {_r('confidence', 3)} AS confidence, {_r('country_match', 3)} AS country_match FROM found")
def evidence_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions.numbers import round_up

    return _found(spark, sf_dir).select("query_id", "cn8", "heading", "hits", "match_count", round_up(F.col("confidence"), 3).alias("confidence"), round_up(F.col("country_match"), 3).alias("country_match"))


@query(f"""WITH {_FOUND}, c AS (SELECT DISTINCT query_id, cn8 FROM found WHERE match_count >= 1), pool AS (SELECT DISTINCT query_id, cn8 FROM found WHERE rank = 1), nom AS (SELECT DISTINCT cn8 FROM declarations WHERE id % 2 = 0)
  SELECT query_id, cn8, false AS injected FROM pool UNION ALL SELECT query_id, cn8, true FROM c JOIN nom USING (cn8) WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.query_id = c.query_id AND p.cn8 = c.cn8)""")
def knowledge_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(_found(spark, sf_dir), "found")  # read three times
    return search.inject(found.where("rank = 1"), found, declarations(spark, sf_dir).where("id % 2 = 0").select("cn8"))


@query(f"""WITH {_FOUND} SELECT query_id, cn8, {_r(_r('least(0.99, 0.45 * least(1.0, match_count / 25.0) + 0.45 * similarity + 0.10 * country_match)', 4), 3)} AS candidate_confidence, match_count >= 2 AND confidence >= 0.35 AS qualifies FROM found""")
def knowledge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions.numbers import round_up

    found = _found(spark, sf_dir)
    score = search.candidate_confidence(F.col("match_count"), F.col("similarity"), F.col("country_match"))
    return found.select("query_id", "cn8", round_up(score, 3).alias("candidate_confidence"), ((F.col("match_count") >= 2) & (F.col("confidence") >= 0.35)).alias("qualifies"))


#: Nomenclature: parts by code, with name, brand and type as leaf, heading and chapter.
_WORDS = """part_words AS (SELECT lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 6, '0') AS cn8, unnest([
    {'layer': 'cn8', 'w': string_split(lower(p_name), ' ')}, {'layer': 'heading', 'w': [lower(replace(p_brand, '#', ''))]}, {'layer': 'chapter', 'w': [lower(p_type)]}], recursive := true) FROM part),
  words AS (SELECT cn8, layer, unnest(w) AS term FROM part_words), wants AS (SELECT DISTINCT c_custkey AS query_id, unnest([
    {'term': split_part('small red blue hot large green cold steel', ' ', CAST(c_custkey % 8 + 1 AS INTEGER)), 'weight': 1.0}, {'term': split_part('ring widget bolt gear nut plate screw pin', ' ', CAST(c_custkey % 7 + 1 AS INTEGER)), 'weight': 0.8},
    {'term': 'brand' || (c_custkey % 25), 'weight': 0.5}, {'term': lower(split_part('ECONOMY SMALL LARGE PROMO', ' ', CAST(c_custkey % 4 + 1 AS INTEGER))), 'weight': 0.3}], recursive := true) FROM customer)"""
_SCORED = f"""{_WORDS}, b AS (SELECT cn8, term, max(CASE layer WHEN 'cn8' THEN 3.0 WHEN 'heading' THEN 2.2 ELSE 1.4 END) AS f FROM words GROUP BY 1, 2), tw AS (SELECT query_id, term, max(weight) AS weight FROM wants GROUP BY 1, 2),
  sc AS (SELECT query_id, cn8, {_r('sum(weight * f)', 6)} AS score, count(*) AS terms FROM tw JOIN b USING (term) GROUP BY 1, 2)"""


def _nomenclature(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("cn8", code_of(F.col("p_size"), F.col("p_partkey")))
    layers = F.array(
        F.struct(F.lit("cn8").alias("layer"), F.split(F.lower("p_name"), " ").alias("w")), F.struct(F.lit("heading").alias("layer"), F.array(F.lower(F.regexp_replace("p_brand", "#", ""))).alias("w")), F.struct(F.lit("chapter").alias("layer"), F.array(F.lower("p_type")).alias("w"))
    )
    return part.select("cn8", F.inline(layers)).select("cn8", "layer", F.explode("w").alias("term"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*(F.lit(w) for w in words.split())), (k % n + 1).cast("int"))
    terms = [(pick("small red blue hot large green cold steel", 8), 1.0), (pick("ring widget bolt gear nut plate screw pin", 7), 0.8), (F.concat(F.lit("brand"), (k % 25).cast("string")), 0.5), (F.lower(pick("ECONOMY SMALL LARGE PROMO", 4)), 0.3)]
    rows = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.inline(F.array(*(F.struct(t.alias("term"), F.lit(w).alias("weight"), F.lit(i).alias("ord")) for i, (t, w) in enumerate(terms)))))
    return ranking.weighted_terms(rows)


@query(f"""WITH {_SCORED}, fo AS (SELECT query_id, count(*) FILTER (weight >= 1) AS focus FROM tw GROUP BY 1),
  h AS (SELECT query_id, cn8, focus, hh, score + CASE WHEN substr(cn8, 1, 2) = lpad(CAST(query_id % 50 + 1 AS VARCHAR), 2, '0') THEN 4.0 ELSE 0.0 END + CASE WHEN hh THEN 5.0 ELSE 0.0 END AS score
    FROM (SELECT *, substr(cn8, 1, 4) = lpad(CAST(query_id % 50 + 1 AS VARCHAR), 2, '0') || '00' AND query_id % 3 = 0 AS hh FROM sc) JOIN fo USING (query_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cn8) - 1 AS rank, max(score) OVER (PARTITION BY query_id) AS best, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, cn8) AS nxt FROM h WHERE score >= 2.0),
  c AS (SELECT *, least(0.97, greatest(0.38, (0.55 * score / best + 0.33 * least(1.0, focus / 4.0) + CASE WHEN hh THEN 0.12 ELSE 0.0 END) * 0.94)) AS base, CASE WHEN score / best > 0.95 THEN greatest(0.72, greatest(0.78, 1.0 - 0.11 * rank) - 0.05) ELSE greatest(0.78, 1.0 - 0.11 * rank) END AS decay FROM r WHERE rank < 5),
  d AS (SELECT *, {_r('CASE WHEN rank > 0 THEN base * decay ELSE base END', 2)} AS confidence FROM c), e AS (SELECT *, least(confidence, CASE WHEN rank > 0 THEN greatest(0.38, 0.97 - 0.06 * rank) ELSE 0.97 END) AS capped FROM d)
  SELECT query_id, cn8, {_r('score', 4)} AS score, rank, {_r('confidence', 1)} AS confidence, CASE WHEN rank = 0 THEN CASE WHEN capped < 0.55 OR (nxt IS NOT NULL AND (score - nxt) / score < 0.05 AND capped < 0.75) THEN 'EXPERT_REQUIRED' ELSE 'SUGGEST' END END AS state FROM e""")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions.numbers import round_up

    terms = _terms(spark, sf_dir)
    hint = F.lpad((F.col("query_id") % 50 + 1).cast("string"), 2, "0")
    named = F.when(F.col("query_id") % 3 == 0, F.array(hint, F.concat(hint, F.lit("00")))).otherwise(F.array(hint))
    hints = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")).select("query_id", F.explode(named).alias("hint"))
    ranked = ranking.rank(ranking.best(terms, _nomenclature(spark, sf_dir), hints, 6), 5)
    return ranked.select("query_id", "cn8", round_up(F.col("score"), 4).alias("score"), F.col("rank").cast("bigint").alias("rank"), round_up(F.col("confidence"), 1).alias("confidence"), "state")


@query(f"""WITH {_SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cn8) AS k FROM sc WHERE score >= 2.0), p AS (SELECT * FROM t WHERE k <= 8), x AS (SELECT *, CASE WHEN CAST(substr(cn8, 3, 6) AS INTEGER) % 5 = 0 THEN 0.9 END AS ex FROM p),
  y AS (SELECT *, bool_or(ex IS NOT NULL) OVER (PARTITION BY query_id) AS anyx, substr(cn8, 1, 4) AS hd FROM x), st AS (SELECT DISTINCT query_id, hd FROM y WHERE ex IS NOT NULL OR k = 1)
  SELECT y.query_id, cn8, {_r('score * (1 + CASE WHEN ex IS NOT NULL THEN 0.18 * ex WHEN NOT anyx AND st.hd IS NOT NULL THEN 0.18 * 0.9 * 0.2 ELSE 0.0 END)', 4)} AS score FROM y LEFT JOIN st ON st.query_id = y.query_id AND st.hd = y.hd""")
def validation_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from customsloom.functions.numbers import round_up

    top = ranking.best(_terms(spark, sf_dir), _nomenclature(spark, sf_dir), None, 8)
    top = top.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cn8"))).persist()  # read three times
    exact = top.where(F.substring("cn8", 3, 6).cast("int") % 5 == 0).select("query_id", "cn8", F.substring("cn8", 1, 4).alias("heading"), F.lit(0.9).alias("confidence"))
    first = top.where("k = 1").select("query_id", F.lit("none").alias("cn8"), F.substring("cn8", 1, 4).alias("heading"), F.lit(0.9).alias("confidence"))
    return ranking.validation(top, exact.unionByName(first)).select("query_id", "cn8", round_up(F.col("score"), 4).alias("score"))


@query(f"""WITH {_WORDS}, a AS (SELECT query_id, cn8, term AS hint, row_number() OVER (PARTITION BY query_id, term ORDER BY cn8) AS k FROM (SELECT DISTINCT query_id, term FROM wants) JOIN (SELECT DISTINCT cn8, term FROM words WHERE layer = 'heading') USING (term)),
  b AS (SELECT query_id, cn8, term AS hint, row_number() OVER (PARTITION BY query_id, term ORDER BY cn8) AS k FROM (SELECT DISTINCT query_id, term FROM wants) JOIN (SELECT DISTINCT cn8, term FROM words WHERE layer = 'cn8') USING (term)),
  u AS (SELECT query_id, cn8, 0 AS stage FROM a WHERE k <= 5 UNION ALL SELECT query_id, cn8, 1 FROM b WHERE k <= 10), o AS (SELECT query_id, cn8, min(stage) AS stage FROM u GROUP BY 1, 2)
  SELECT query_id, cn8, stage, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, cn8) AS place FROM o) WHERE place <= 12""")
def candidate_pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _nomenclature(spark, sf_dir)
    asked = _terms(spark, sf_dir).select("query_id", F.col("term").alias("hint"))
    stage = lambda layer, k: (asked.join(search.first_of_hints(words.where(F.col("layer") == layer).select("cn8", F.col("term").alias("hint")).distinct().withColumn("ord", F.lit(0)), k), "hint"), k)
    return search.pool([stage("heading", 5), stage("cn8", 10)], 12).select("query_id", "cn8", "stage", F.col("place").cast("bigint").alias("place"))


_FOLDED = f"""{DECLARATIONS}, fw AS (SELECT id, cn8, heading, weight, source, description, {_TOKENS.format(x='strip_accents(lower(description))', n=2)} AS w FROM declarations)"""


@query(f"""WITH {_FOLDED}, g AS (SELECT id, cn8, weight, list_distinct(list_filter(flatten(list_transform([2, 3, 4], lambda n: list_transform(generate_series(1, greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i : i + n - 1], ' ')))), lambda p: length(p) >= 6)) AS ph FROM fw),
  e AS (SELECT cn8, weight, unnest(ph) AS phrase FROM g) SELECT phrase, cn8, {_r('sum(weight)', 2)} AS weight FROM e GROUP BY 1, 2 HAVING {_r('sum(weight)', 2)} >= 2""")
def ngram_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.phrase_lexicon(declarations(spark, sf_dir), least=2.0, sizes=(2, 4))


@query(f"""WITH {_FOLDED}, g AS (SELECT cn8, source, description, unnest(list_distinct(list_filter(flatten(list_transform([2, 3, 4], lambda n: list_transform(generate_series(1, greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i : i + n - 1], ' ')))), lambda p: length(p) >= 6))) AS phrase FROM fw)
  SELECT phrase, cn8, count(*) AS frequency, count(DISTINCT description) AS unique_descriptions, count(*) FILTER (source = 'seed') AS seed_hits, count(*) FILTER (source <> 'seed') AS other_hits FROM g GROUP BY 1, 2 HAVING count(*) >= 3""")
def phrase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.phrase_stats(declarations(spark, sf_dir), sizes=(2, 4), least=3)


@query(ORACLES["ngram_lexicon"].removesuffix(">= 2") + ">= 5")
def ngram_lexicon_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own least weight."""
    return mining.phrase_lexicon(declarations(spark, sf_dir))


@query(ORACLES["phrase_stats"])
def phrase_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_stats(spark, sf_dir)


@query(f"""WITH {DECLARATIONS}, br AS (SELECT unnest(['that', 'para', 'elle', 'nicht']) AS brand), w AS (SELECT DISTINCT id, cn8, weight, unnest(regexp_extract_all(lower(description), '[a-z0-9]+')) AS brand FROM declarations)
  SELECT brand, cn8, {_r('sum(weight)', 2)} AS frequency FROM w JOIN br USING (brand) GROUP BY 1, 2""")
def brand_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = spark.createDataFrame([("that",), ("para",), ("elle",), ("nicht",)], "brand string")
    return mining.brand_map(declarations(spark, sf_dir), brands)


@query(f"""WITH {DECLARATIONS}, t AS (SELECT heading, cn8, weight, {_TOKENS.format(x='strip_accents(lower(description))', n=3)} AS w FROM declarations), p AS (SELECT heading, cn8, weight, CASE WHEN len(w) >= 2 THEN array_to_string(w[1:4], ' ') END AS phrase FROM t),
  c AS (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY w DESC, cn8) AS k FROM (SELECT heading, cn8, {_r('sum(weight)', 2)} AS w FROM p GROUP BY 1, 2)), f AS (SELECT *, row_number() OVER (PARTITION BY heading ORDER BY w DESC, phrase) AS k FROM (SELECT heading, phrase, {_r('sum(weight)', 2)} AS w FROM p WHERE phrase IS NOT NULL GROUP BY 1, 2))
  SELECT heading, weight, top_cn8, top_phrase FROM (SELECT heading, {_r('sum(weight)', 2)} AS weight FROM p GROUP BY 1) LEFT JOIN (SELECT heading, string_agg(cn8, '|' ORDER BY k) AS top_cn8 FROM c WHERE k <= 8 GROUP BY 1) USING (heading)
  LEFT JOIN (SELECT heading, string_agg(phrase, '|' ORDER BY k) AS top_phrase FROM f WHERE k <= 12 GROUP BY 1) USING (heading)""")
def heading_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.heading_profiles(declarations(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT p_name AS phrase, p_type AS cn8 FROM part), k AS (SELECT unnest(['ring', 'red widget', 'very hot gear']) AS known)
  SELECT phrase, cn8 FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE contains(' ' || phrase || ' ', ' ' || known || ' ') OR contains(' ' || known || ' ', ' ' || phrase || ' '))""")
def taxonomy_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("ring",), ("red widget",), ("very hot gear",)], "phrase string")
    return mining.without_covered(table(spark, sf_dir, "part").select(F.col("p_name").alias("phrase"), F.col("p_type").alias("cn8")).distinct(), known)


@query("""WITH p AS (SELECT p_type AS cn8, p_name AS phrase, CAST(count(*) AS DOUBLE) AS score FROM part GROUP BY 1, 2 UNION ALL SELECT p_type, split_part(p_name, ' ', 2), CAST(min(p_size) AS DOUBLE) FROM part GROUP BY 1, 2)
  SELECT cn8, phrase, score FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.cn8 = b.cn8 AND length(a.phrase) < length(b.phrase) AND b.score >= a.score AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' '))""")
def maximal_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    whole = part.groupBy(F.col("p_type").alias("cn8"), F.col("p_name").alias("phrase")).agg(F.count("*").cast("double").alias("score"))
    word = part.groupBy(F.col("p_type").alias("cn8"), F.try_element_at(F.split("p_name", " "), F.lit(2)).alias("phrase")).agg(F.min("p_size").cast("double").alias("score"))
    return mining.maximal_phrases(whole.unionByName(word))


@query(f"""WITH {_FOUND.replace('sum(weight) AS w,', 'CAST(count(*) AS DOUBLE) AS w,').replace('sum(abs(score) * weight)', 'sum(abs(score))').replace("THEN weight ELSE 0.0::DOUBLE END", "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")}
  SELECT query_id, cn8, match_count, {_r('confidence', 3)} AS confidence FROM found""")
def evidence_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from customsloom.functions.numbers import round_up

    found = search.evidence(_told(spark, sf_dir), "EN", weighted=False)
    return found.select("query_id", "cn8", "match_count", round_up(F.col("confidence"), 3).alias("confidence"))


@query(f"""WITH {DECLARATIONS}, n AS (SELECT id AS cn8, description AS t FROM declarations), d AS (SELECT cn8, {_TOKENS.format(x='t', n=4)} AS w FROM n), st AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM d), v AS (SELECT DISTINCT unnest(w) AS term FROM d),
  k AS (SELECT item_id AS query_id, unnest({_TOKENS.format(x='text', n=4)}[1:16]) AS token FROM benchmark), q AS (SELECT DISTINCT query_id, term FROM k JOIN v ON starts_with(term, token)),
  p AS (SELECT cn8, length, term, count(*) AS tf FROM (SELECT cn8, len(w) AS length, unnest(w) AS term FROM d) JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS n FROM p GROUP BY 1),
  i AS (SELECT term, mean, greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) AS idf FROM f, st), s AS (SELECT query_id, cn8, {_r('sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))', 6)} AS score FROM q JOIN p USING (term) JOIN i USING (term) GROUP BY 1, 2)
  SELECT query_id, cn8, {_r('score', 3)} AS score, substr(t, 1, 12) AS starts FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cn8) AS rank FROM s) JOIN n USING (cn8) WHERE rank <= 10""")
def nomenclature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 words of each benchmark item, as beginnings of words, over declarations as a nomenclature."""
    from customsloom.functions.numbers import round_up

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    known = declarations(spark, sf_dir).select(F.col("id").alias("cn8"), F.col("description").alias("text"))
    return search.nomenclature_search(asked, known, 10).select("query_id", "cn8", round_up(F.col("score"), 3).alias("score"), F.substring("text", 1, 12).alias("starts"))


@query(f"""WITH {_FOUND}, fc AS (SELECT * REPLACE (least(0.99, confidence * 12) AS confidence, match_count * 15 AS match_count) FROM found), c AS (SELECT *, heading < '0050' AS low FROM fc WHERE match_count >= 2 AND confidence >= 0.35 AND heading NOT IN ('0010', '0020')), sp AS (SELECT *, bool_or(low) OVER (PARTITION BY query_id) AS anylow FROM c)
  SELECT query_id, cn8, match_count > 20 AND confidence > 0.85 AS strong FROM sp WHERE low OR NOT anylow""")
def knowledge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of enough declarations in no blocked heading, within a query's space or all of them if none is; and which of them are strong."""
    surer = _found(spark, sf_dir).withColumns({"confidence": F.least(F.lit(0.99), F.col("confidence") * 12), "match_count": F.col("match_count") * 15})  # as if of a larger history
    kept = search.knowledge_candidates(surer, blocked=["0010", "0020"])
    return search.in_space_or_all(kept, F.col("heading") < "0050").select("query_id", "cn8", search.strong(F.col("match_count"), F.col("confidence")).alias("strong"))
