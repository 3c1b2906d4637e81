"""The supplied tables as invoices, lines, declarations and route points; the same as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PREFERENCE = {"A": "YES", "R": "NO", "N": "NOT_DECLARED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(size: Column, key: Column) -> Column:
    return F.concat(F.lpad(size.cast("string"), 2, "0"), F.lpad((key % 10000).cast("string"), 6, "0"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines.  (invoice_id, position) is no key: positions repeat and have gaps."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    origin = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("country"))
    both = item.join(part, F.col("l_partkey") == F.col("p_partkey")).join(origin, F.col("l_suppkey") == F.col("s_suppkey"))
    flag = F.col("l_returnflag")
    preference = F.when(flag == "A", "YES").when(flag == "R", "NO").when(flag == "N", "NOT_DECLARED").otherwise("UNKNOWN")
    weight = F.when(F.col("p_size") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("p_size") * F.col("l_quantity") / 10)
    return both.select(
        F.col("l_orderkey").alias("invoice_id"), F.col("l_linenumber").alias("position"), F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("line_total"),
        code_of(F.col("p_size"), F.col("p_partkey")).alias("hs_code"), "country", preference.alias("preference"), weight.alias("net_weight"), F.col("l_partkey").alias("part_id"), F.col("p_brand").alias("brand"),
    )


LINES = """lines AS (
  SELECT l_orderkey AS invoice_id, l_linenumber AS position, p_name AS description, l_quantity AS quantity, l_extendedprice AS line_total,
    lpad(CAST(p_size AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 10000 AS VARCHAR), 6, '0') AS hs_code, n_name AS country,
    CASE l_returnflag WHEN 'A' THEN 'YES' WHEN 'R' THEN 'NO' WHEN 'N' THEN 'NOT_DECLARED' ELSE 'UNKNOWN' END AS preference,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * l_quantity / 10 END AS net_weight, l_partkey AS part_id, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_totalprice").alias("total_value"), F.col("o_orderdate").cast("date").alias("invoice_date"), F.col("c_nationkey").alias("destination"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
    )


INVOICES = """invoices AS (
  SELECT o_orderkey AS invoice_id, o_totalprice AS total_value, CAST(o_orderdate AS DATE) AS invoice_date, c_nationkey AS destination, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

#: Weight of a declaration's source, by the last digit of its id.  Fixed values.
WEIGHTS = {"export": 0.6, "import": 0.4, "seed": 1.0}


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with long descriptions: whole documents with a code by hash of the id, weighed by source."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    source = F.when(F.col("doc_id") % 3 == 0, "export").when(F.col("doc_id") % 3 == 1, "import").otherwise("seed")
    weight = F.when(F.col("doc_id") % 3 == 0, 0.6).when(F.col("doc_id") % 3 == 1, 0.4).otherwise(1.0)
    code = F.lpad(((F.col("doc_id") * 7919) % 97).cast("string"), 4, "0")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("description"), F.upper("lang").alias("country"), source.alias("source"), weight.alias("weight"), F.concat(code, F.lpad((F.col("doc_id") % 5).cast("string"), 4, "0")).alias("cn8"), code.alias("heading"))


DECLARATIONS = """declarations AS (
  SELECT doc_id AS id, text AS description, upper(lang) AS country, CASE doc_id % 3 WHEN 0 THEN 'export' WHEN 1 THEN 'import' ELSE 'seed' END AS source,
    CASE doc_id % 3 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    lpad(CAST((doc_id * 7919) % 97 AS VARCHAR), 4, '0') || lpad(CAST(doc_id % 5 AS VARCHAR), 4, '0') AS cn8, lpad(CAST((doc_id * 7919) % 97 AS VARCHAR), 4, '0') AS heading
  FROM documents WHERE text IS NOT NULL)"""


def money(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def grams(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5) / 1000"
