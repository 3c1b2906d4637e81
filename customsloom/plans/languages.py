"""Languages of turns of conversations, with profiles learned from labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.operators import languages
from customsloom.operators.languages import Detector
from customsloom.plans.bindings import table
from customsloom.plans.matching import _values
from customsloom.plans.registry import query

PHRASES = [("fr", "éeaument"), ("fr", "éanement"), ("es", "ciónmiento"), ("de", "schlichkeitü"), ("de", "überlich"), ("en", "thererés"), ("fr", "laéan"), ("es", "adañera")]

_LETTER_CASES = " ".join(f"WHEN regexp_matches(low, '{signs}') THEN '{language}'" for language, signs in languages.LETTERS)
_PLAIN = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}]+', ' ', 'g')) || ' '"


@query(rf"""WITH c AS (SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 9 WHEN 0 THEN 'Temperature sensor' WHEN 1 THEN 'temperaturni senzor 5' WHEN 2 THEN '  ' ELSE text END AS text FROM conversations), l AS (SELECT *, lower(text) AS low FROM c),
  ph AS (SELECT id, arg_min(language, -length(phrase) * 100 + ascii(language) - 97) AS language FROM l JOIN (SELECT * FROM {_values([p for p in PHRASES if p[0] != "en" and len(p[1]) >= 8], "language, phrase")}) ON contains(low, phrase) GROUP BY 1),
  g AS (SELECT language, substr(x, i, 3) AS gram, count(*) AS n FROM (SELECT lang AS language, x, unnest(generate_series(1, length(x) - 2)) AS i FROM (SELECT lang, {_PLAIN.format("text")} AS x FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL)) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, gram) AS r, sum(n) OVER (PARTITION BY language) AS total FROM g), p AS (SELECT language, gram, ln(n / total::DOUBLE) AS weight, ln(min(n) OVER (PARTITION BY language) * {languages.MISSING}::DOUBLE / total) AS lack FROM r WHERE r <= {languages.TOP}),
  o AS (SELECT id, substr(x, i, 3) AS gram, count(*) AS n FROM (SELECT id, x, unnest(generate_series(1, length(x) - 2)) AS i FROM (SELECT id, {_PLAIN.format("text")} AS x FROM l)) GROUP BY 1, 2), z AS (SELECT id, sum(n) AS size FROM o GROUP BY 1),
  s AS (SELECT id, language, (sum(n * (weight - lack)) / any_value(size) + any_value(lack)) * least(any_value(size), 50) AS score FROM o JOIN p USING (gram) JOIN z USING (id) GROUP BY 1, 2),
  b AS (SELECT id, max(score) AS top FROM s GROUP BY 1), pr AS (SELECT id, arg_max(language, score) AS language, greatest({languages.LEAST}::DOUBLE, floor(1 / sum(exp(score - top)) * 100 + 0.5) / 100) AS confidence FROM s JOIN b USING (id) GROUP BY 1),
  d AS (SELECT l.id, l.text, CASE WHEN trim(l.text) = '' THEN 1 WHEN l.text = 'Temperature sensor' THEN 2 WHEN ph.language IS NOT NULL THEN 3 WHEN regexp_matches(l.text, '\b(senzor|temperaturni)\b') THEN 4 WHEN regexp_matches(low, '[äöüßćđčšžñ¿¡êèœ]') THEN 5 WHEN pr.language IS NOT NULL THEN 6 ELSE 7 END AS k, ph.language AS a, CASE {_LETTER_CASES} END AS c, pr.language AS e, pr.confidence AS f FROM l LEFT JOIN ph USING (id) LEFT JOIN pr USING (id))
  SELECT id, CASE k WHEN 3 THEN a WHEN 4 THEN 'sl' WHEN 5 THEN c WHEN 6 THEN e ELSE 'en' END AS language, ['empty', 'technical', 'phrases', 'slovenian', 'letters', 'profile', 'default'][k] AS stage, CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 0.88 WHEN 3 THEN CASE WHEN length(trim(text)) < 24 THEN 0.8 ELSE 0.95 END WHEN 4 THEN 0.88 WHEN 5 THEN 0.85 WHEN 6 THEN f ELSE 0.5 END AS confidence FROM d""")
def language_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every turn, the detector that said so, and how sure it was."""
    c, t = F.col("conv_id"), F.col("turn")
    kind = (c + t) % 9
    text = F.when(kind == 0, "Temperature sensor").when(kind == 1, "temperaturni senzor 5").when(kind == 2, "  ").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select((c * 1000 + t).alias("id"), text.alias("text"))
    known = languages.profiles(table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "text"))
    x = F.col("text")
    return languages.cascade(rows, [
        Detector("technical", languages.technical_english(x)), Detector("phrases", table=languages.phrases(spark.createDataFrame(PHRASES, "language string, phrase string"))),
        Detector("slovenian", languages.slovenian_words(x)), Detector("letters", languages.letters(x)), Detector("profile", table=languages.by_profile(known)),
    ])
