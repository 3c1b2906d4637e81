"""Licence scan by canonical digests, in DataFrame functions only.

A text is lower-cased; lines of copyright statements go; the rest is joined, every run of other signs than letters and digits
becomes one space, and equivalent spellings become one, so that it doesn't matter where lines break.  The SHA-256 of what is left
is the text's digest: entire texts are hash-joined with the digests of known licences.  The digests of single lines are looked up
among known notices, so that a document that only names its licence is found, too.

The known licences are a list in the program, bounded by ``MOST_KNOWN``, and so may be broadcast; or a table of digests of any
size, which is joined as Spark sees fit (its notices are bounded by ``MOST_KNOWN``).  Nothing of the documents is shuffled for
the list.

Defined cases.  A null text has null digest, no licence and no notices; an empty text, and one of copyright lines alone, has
the digest of nothing, which no licence has.  Of licences with one digest the least identifier counts; of a whole text and a
header the whole text.  A copyright statement counts as one only if it starts its line; what follows on that line goes with it.
Repeated rows are judged one by one; a null id is carried through.  Columns of the input that the result has too are replaced;
all others are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from customsloom.llm.common import free_names
from customsloom.llm.license_texts import DIGESTS, KNOWN

MOST_KNOWN = 5_000
#: A line that states a copyright: the word with a year or sign, a sign alone, or the reservation of rights.
COPYRIGHT = r"^[^\p{L}\p{N}©]*(copyright\b.*([0-9]{4}|\(c\)|©|<year>|\[yyyy\])|\(c\).*\b(19|20)[0-9]{2}\b|\(c\) *<year>|©|all rights reserved)"
SIGNS = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, as (pattern, replacement); $1 and $2 are groups.
SPELLINGS = [
    (r"\b(sub |un|)licenc", "$1licens"),
    (r"\b(author|organ|recogn|util|initial|real|custom|general|summar|minim|maxim)is(e|ed|es|er|ers|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(col|fav|behavi|hon|lab)our", "$1or"),
    (r"\b(sub|non) (licens|commercial|infring|profit)", "$1$2"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bhttps\b", "http"),
    (r"\bper cent\b", "percent"),
]


def canonical(text: Column) -> Column:
    """A text, or a part of one, in canonical form; null if it is null."""
    x = F.trim(F.regexp_replace(text, SIGNS, " "))
    for pattern, put in SPELLINGS:
        x = F.regexp_replace(x, pattern, put)
    return x


def counting_lines(text: Column) -> Column:
    """The lower-cased lines of a text that aren't copyright statements."""
    return F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT))


def digest(lines: Column) -> Column:
    return F.sha2(canonical(F.array_join(lines, " ")), 256)


def known_digests(spark, known: list[tuple[str, str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """license_id, kind (text, header or notice), digest of the known texts and notices."""
    if len(known) + len(digests) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    rows = spark.createDataFrame(known, "license_id string, kind string, text string")
    rows = rows.select("license_id", "kind", digest(counting_lines(F.col("text"))).alias("digest"))
    return rows.unionAll(spark.createDataFrame([(i, "text", d) for i, d in digests], "license_id string, kind string, digest string"))


def scan(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """All rows and columns with text_digest, license_id and license_kind (of the entire text), notices (licences named by a line, sorted) and n_notices.

    ``known`` is a table like that of ``known_digests``, which is taken where there is none; its notices must hold
    the word licens- (after spellings), as lines without it aren't looked up.
    """
    table = known_digests(docs.sparkSession) if known is None else known
    noted = table.where("kind = 'notice' AND digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id")).limit(MOST_KNOWN + 1).collect()
    if len(noted) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known notices")
    notices = {r["digest"]: r["license_id"] for r in noted}
    best = F.min(F.struct((F.col("kind") != "text").alias("less"), "license_id", "kind"))
    rows = docs.drop("text_digest", "license_id", "license_kind", "notices", "n_notices")
    lines, named, key, hit = free_names(rows, "lines", "named", "key", "hit")
    texts = table.where("kind IN ('text', 'header') AND digest IS NOT NULL").groupBy(F.col("digest").alias(key)).agg(best.alias(hit))
    rows = rows.withColumn(lines, counting_lines(F.col(text_col)))
    # no spelling makes this word from another
    some = F.transform(F.filter(lines, lambda x: x.contains("licens") | x.contains("licenc")), lambda x: F.sha2(canonical(x), 256))
    hits = F.array_intersect(some, F.array(*(F.lit(d) for d in sorted(notices)))) if notices else F.array().cast("array<string>")
    names = F.create_map(*(F.lit(x) for pair in sorted(notices.items()) for x in pair)) if notices else F.create_map().cast("map<string,string>")
    rows = rows.withColumns({"text_digest": digest(F.col(lines)), named: F.coalesce(F.array_sort(F.array_distinct(F.transform(hits, lambda x: names[x]))), F.array().cast("array<string>"))}).drop(lines)
    out = rows.join(F.broadcast(texts) if known is None else texts, F.col("text_digest") == F.col(key), "left").drop(key)
    return out.withColumns({"license_id": F.col(hit)["license_id"], "license_kind": F.col(hit)["kind"], "notices": F.array_join(named, ","), "n_notices": F.size(named)}).drop(named, hit)


def scan_documents(docs: DataFrame) -> DataFrame:
    out = scan(docs.select("doc_id", "text"))
    return out.select("doc_id", "text_digest", "license_id", "license_kind", "notices", "n_notices")


def oracle_sql() -> str:
    """The scan of ``documents`` for DuckDB."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canonical_sql(x: str) -> str:
        x = f"trim(regexp_replace({x}, {text(SIGNS)}, ' ', 'g'))"
        for pattern, put in SPELLINGS:
            x = f"regexp_replace({x}, {text(pattern)}, {text(put.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
        return x

    def lines(x: str) -> str:
        return f"list_filter(string_split(lower({x}), chr(10)), lambda x: NOT regexp_matches(x, {text(COPYRIGHT)}))"

    def whole(x: str) -> str:
        joined = f"array_to_string({x}, ' ')"
        return f"sha256({canonical_sql(joined)})"

    values = ", ".join(f"({text(a)}, {text(b)}, {text(c)})" for a, b, c in KNOWN)
    digests = "".join(f" UNION ALL SELECT {text(a)}, 'text', {text(d)}" for a, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT license_id, kind, {whole(lines('t'))} AS digest FROM (VALUES {values}) v(license_id, kind, t){digests}
), texts AS (
  SELECT digest, min(struct_pack(less := kind <> 'text', license_id := license_id, kind := kind)) AS k FROM known WHERE kind <> 'notice' GROUP BY digest
), d AS (SELECT doc_id, row_number() OVER () AS r, {lines('text')} AS l FROM documents),
whole AS (SELECT doc_id, r, {whole('l')} AS text_digest FROM d),
named AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(DISTINCT license_id) AS n
  FROM (SELECT r, sha256({canonical_sql('x')}) AS digest FROM (SELECT r, unnest(l) AS x FROM d)) y JOIN (SELECT digest, min(license_id) AS license_id FROM known WHERE kind = 'notice' GROUP BY 1) USING (digest) GROUP BY r
)
SELECT w.doc_id, w.text_digest, t.k.license_id AS license_id, t.k.kind AS license_kind, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS INTEGER) AS n_notices
FROM whole w LEFT JOIN texts t ON t.digest = w.text_digest LEFT JOIN named n USING (r)
"""
