"""URL filter: given rules first, then association rules mined by Spark's FP-growth from the urls that the given rules label.

A url becomes a set of tokens: scheme, host labels, the registered part of the host, path segments, the file ending and query
keys, all of them.  FP-growth over the labelled urls, each with its verdict as one more token,
gives the frequent token sets; those that hold a verdict make rules, kept if support and confidence suffice and no rule with
one token less is as confident.  A rule is indexed under its rarest token; a url meets only the rules of its own tokens, and
the most confident of those that it holds entirely decides (then larger support, fewer tokens, block before allow).  Urls of
equal tokens are judged once.  Before mining, tokens below the least support go, as no rule can hold them, and tokens that the
labelled urls hold together or not at all become one item, which a url holds if it has any of them: a rule with two of them is
no more confident than one with either.  So a crowd of equal urls is one item, however many tokens they have.  Items
whose urls all have one verdict are rules by themselves, with confidence 1, and any larger set with one of them has less support and is no
more confident: they are left out of mining.  What is mined are sets of items that stand under both verdicts.

Defined cases.  A null url, or one without ``://``, has empty host, path and tokens; it fits no given rule.  A url that no rule
decides gets the labelled urls' most frequent verdict (allow, if there are none).  Repeated rows count each time in mining and
are judged one by one; a null id is carried through; other columns are kept, whatever their names, but for those that the result
adds.  The url column is text in the result.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from customsloom.llm.common import free_names, written

#: Given rules: verdict, host and path.  Of those that fit, the longest wins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Least share of the labelled urls, least number of them, and least confidence of a mined rule.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.005, 3, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the path) of a url; empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(?s:(.*))", 1)


def given(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column, rest: Column) -> Column:
    """The url's distinct tokens, sorted."""
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    keys = F.transform(F.filter(F.split(F.regexp_extract(rest, r"^\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.regexp_extract(x, "^[^=]*", 0)))
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))), F.concat(F.lit("site:"), F.array_join(F.reverse(F.slice(labels, 1, 3)), "."))),
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), x)),
        F.array(F.concat(F.lit("end:"), F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,8}|/)$", 1))),
        keys,
    )
    return F.when(host != "", F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def alike(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, item, n, pure) of the frequent tokens of columns tokens and verdict: item is the least of the tokens that the same n rows hold, pure the verdict of all of them if it is one."""
    least = math.ceil(min_support * labelled.count())
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("n"), F.min("verdict").alias("lo"), F.max("verdict").alias("hi"))
    total = lambda salt: F.sum(F.xxhash64("tokens", F.lit(salt)).cast("decimal(38,0)")).alias(f"h{salt}")
    each = sets.select("tokens", "n", "lo", "hi", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), total(1), total(2)).where(F.col("n") >= least)
    groups = each.groupBy("n", "h1", "h2").agg(F.min("token").alias("item"), F.collect_list("token").alias("all"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return groups.select(F.explode("all").alias("token"), "item", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("pure"))


def itemised(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct rows of column tokens that hold an item, with held: item to the last of its tokens that the row has."""
    each = sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    return each.groupBy("tokens", "item").agg(F.max("token").alias("token")).groupBy("tokens").agg(F.map_from_entries(F.collect_list(F.struct("item", "token"))).alias("held"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (items, verdict, support, confidence, rarest) from columns tokens and verdict."""
    total = labelled.count()
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(labelled.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))).freqItemsets
    sets = written(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    of = F.filter("items", lambda x: x.startswith("verdict:"))
    own = sets.select(F.filter("items", lambda x: ~x.startswith("verdict:")).alias("items"), F.substring(F.get(of, F.lit(0)), 9, 99).alias("verdict"), "freq").where("verdict IS NOT NULL AND size(items) > 0")
    plain = sets.where(F.size(of) == 0).select("items", F.col("freq").alias("among"))
    rules = own.join(plain, "items").select("items", "verdict", (F.col("freq") / F.lit(max(total, 1))).alias("support"), (F.col("freq") / F.col("among")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    rules = written(rules, "rules")
    less = rules.where("size(items) > 1").select("items", "verdict", "confidence", F.explode("items").alias("out")).select(F.col("items").alias("whole"), "verdict", "confidence", F.array_remove("items", F.col("out")).alias("items"))
    better = less.join(rules.select("items", "verdict", F.col("confidence").alias("c")), ["items", "verdict"]).where("c >= confidence").select(F.col("whole").alias("items"), "verdict").distinct()
    rules = rules.join(better, ["items", "verdict"], "left_anti")
    single = plain.where("size(items) = 1").select(F.get("items", F.lit(0)).alias("token"), F.col("among").alias("n"))
    rarest = rules.select("items", "verdict", F.explode("items").alias("token")).join(single, "token").groupBy("items", "verdict").agg(F.min(F.struct("n", "token")).alias("m"))
    return rules.join(rarest, ["items", "verdict"]).select("items", "verdict", "support", "confidence", F.col("m.token").alias("rarest"))


def single_rules(items: DataFrame, total: int) -> DataFrame:
    """Rules of one item, of those whose rows have one verdict; no rule with more items is as good, so that these items needn't be mined."""
    return items.where("pure IS NOT NULL AND token = item").select(F.array("item").alias("items"), F.col("pure").alias("verdict"), (F.col("n") / F.lit(max(total, 1))).alias("support"), F.lit(1.0).alias("confidence"), F.col("item").alias("rarest"))


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All rows and columns with host, path, rule (given rule or null), verdict, mined (the deciding token set or null) and confidence."""
    host, path, rest = parts(F.col(url_col))
    rows = pages.withColumn(url_col, F.col(url_col).cast("string")).drop(*({"host", "path", "rule", "verdict", "mined", "confidence"} - {url_col}))
    url, given_, tokens_, found, key = free_names(rows, "url", "given", "tokens", "found", "key")
    rows = rows.withColumn(url, F.col(url_col)).withColumns({"host": host, "path": path, tokens_: rest})
    rule, verdict = given(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, given_: verdict, tokens_: tokens(F.col(url), F.col("host"), F.col("path"), F.col(tokens_))}).drop(url)
    some = F.size(tokens_) > 0
    labelled = written(rows.where(F.col(given_).isNotNull() & some).select(F.col(tokens_).alias("tokens"), F.col(given_).alias("verdict")), "labelled")
    usual = labelled.groupBy("verdict").count().orderBy(F.desc("count"), "verdict").first()
    if usual is None:
        out = rows.withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), found: F.lit(None).cast("string")})
    else:
        total = labelled.count()
        min_support = max(min_support, min(1.0, MIN_COUNT / total))
        items = written(alike(labelled, min_support), "items")
        held = F.coalesce(F.array_sort(F.map_keys("held")), F.array().cast("array<string>"))
        mined = mine(labelled.join(itemised(labelled, items.where("pure IS NULL")), "tokens", "left").select(held.alias("tokens"), "verdict"), min_support, min_confidence)
        mined = mined.unionByName(single_rules(items, total))
        sets = itemised(rows.where(F.col(given_).isNull() & some).select(F.col(tokens_).alias("tokens")), items)
        met = sets.select("tokens", "held", F.explode(F.map_keys("held")).alias("rarest")).join(mined, "rarest").where(F.size(F.array_except("items", F.map_keys("held"))) == 0)
        met = met.withColumn("items", F.array_sort(F.transform("items", lambda x: F.col("held")[x])))
        best = met.groupBy("tokens").agg(F.max(F.struct("confidence", "support", (-F.size("items")).alias("few"), "verdict", F.array_join("items", " ").alias("mined"))).alias("b"))
        best = written(best.select(F.col("tokens").alias(key), F.col("b.verdict").alias(found), F.col("b.mined").alias("mined"), F.col("b.confidence").alias("confidence")), "judged")
        # a written table is dealt out for the join alone, so that Spark can split tokens that many urls share
        out = rows.join(best, F.when(some, F.col(tokens_)) == F.col(key), "left").drop(key)
        out = out.withColumns({c: F.when(F.col(given_).isNull(), F.col(c)) for c in (found, "mined", "confidence")})
    out = out.withColumn("verdict", F.coalesce(given_, found, F.lit(usual["verdict"] if usual else "allow")))
    return out.drop(given_, found, tokens_)


def judge_pages(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")
