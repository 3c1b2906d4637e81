"""Workbooks written from the supplied tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from customsloom.plans.bindings import LINES, lines, table
from customsloom.plans.registry import query
from customsloom.sources import sheets
from customsloom.sources.shared import fresh_folder


@query(f"""WITH {LINES} SELECT 'SI' AS export_country, country AS import_country, hs_code AS tariff, description, CAST(net_weight AS DOUBLE) AS net_mass FROM lines WHERE net_weight IS NOT NULL""")
def sheet_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as export sheets (a title above the names, behind a sheet of notes), those with a mass read back by the layout of exports."""
    at = fresh_folder(spark, "sheets")
    own = lines(spark, sf_dir).select(F.lit("SI").alias("Izvoznik"), F.col("country").alias("Prejemnik"), F.col("position").alias("Zap."), F.col("hs_code").alias("Tarifa"), F.col("description").alias("Opis blaga"), F.col("net_weight").alias("Neto masa"))
    sheets.write_sheets(own, at, sheet="AES export 2025", preamble="AES", notes="Izvoz & uvoz")
    rows = sheets.read_declarations(spark, at, "export", where=[("net_mass", "filled")])
    return rows.withColumn("net_mass", F.col("net_mass").cast("double"))


@query("""SELECT o_orderkey AS invoice_id, o_totalprice AS total, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS priority FROM orders WHERE o_totalprice >= 50000 AND CAST(o_orderdate AS DATE) < DATE '1997-01-01' AND o_orderpriority LIKE '%H%'""")
def sheet_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns by name, four of six, in several partitions a file; three conditions are applied at the source."""
    at = fresh_folder(spark, "sheets")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("Customer"), F.col("o_orderkey").alias("Invoice_ID"), F.col("o_orderdate").cast("date").alias("Day"), F.col("o_totalprice").alias("Total"), F.col("o_orderpriority").alias("Priority"), F.col("o_orderstatus").alias("Status"))
    sheets.write_sheets(own, at)
    where = [("total", ">=", 50000), ("day", "<", "1997-01-01"), ("priority", "contains", "H")]
    return sheets.read_sheets(spark, at, "invoice_id bigint, total double, day date, priority string", where, partitionbytes=1 << 20)
