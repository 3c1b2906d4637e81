"""Documents whose odd sources come with broken fonts, each with a substitution of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from customsloom.operators import repair
from customsloom.plans.bindings import table
from customsloom.plans.registry import query

LETTERS = "éèêçóñíüöäß"


def _number() -> Column:
    return F.regexp_extract("source", r"(\d+)$", 1).cast("int")


def _sign(letter: int, font: int) -> int:
    return (3 * letter + 5 * font) % len(repair.SIGNS)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those of odd sources come in one of three fonts, with signs for letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own"), "text", F.when(_number() % 2 == 1, F.concat(F.lit("font"), (_number() % 3).cast("string"))).otherwise("whole").alias("source"))
    lost = F.col("text")
    for font in range(3):
        lost = F.when(F.col("source") == f"font{font}", F.translate("text", LETTERS, "".join(repair.SIGNS[_sign(i, font)] for i in range(len(LETTERS))))).otherwise(lost)
    return docs.withColumn("text", lost)


def _maps(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One font's map is known, of another one two letters are, the rest is inferred from words of whole texts."""
    known = spark.createDataFrame([("font0", repair.SIGNS[_sign(i, 0)], c) for i, c in enumerate(LETTERS)] + [("font1", repair.SIGNS[_sign(i, 1)], LETTERS[i]) for i in (2, 5)], "source string, sign string, letter string")
    words = docs.where(~repair.has_signs(F.col("text"))).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1))).alias("word")).distinct()
    return repair.maps(docs, words, known, LETTERS)


@query(f"SELECT doc_id, source, md5(text) AS text_md5, len(regexp_extract_all(text, '[{LETTERS}]')) > 0 AND CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 1 AS was_broken FROM documents")
def font_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as it was before its font lost letters."""
    docs = _broken(spark, sf_dir)
    done = repair.repaired(docs, _maps(spark, docs))
    return done.select("doc_id", F.col("own").alias("source"), F.md5("text").alias("text_md5"), (F.size("signs") > 0).alias("was_broken"))


@query(f"""WITH l AS (SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS k, unnest(regexp_extract_all(text, '[{LETTERS}]')) AS letter FROM documents), s AS (SELECT DISTINCT k % 3 AS font, letter FROM l WHERE k % 2 = 1
    UNION SELECT 0, unnest(string_split('{LETTERS}', '')))
  SELECT 'font' || font AS font, letter, CAST((3 * (instr('{LETTERS}', letter) - 1) + 5 * font) % {len(repair.SIGNS)} AS INTEGER) AS sign FROM s""")
def font_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the signs of every font stand for, by their number."""
    found = _maps(spark, _broken(spark, sf_dir))
    return found.select(F.col("source").alias("font"), "letter", (F.instr(F.lit(repair.SIGNS), F.col("sign")) - 1).alias("sign"))
