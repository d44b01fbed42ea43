"""Depth-interval tables derived from the driver's relational tables.

An order is a document, its lines are intervals stacked from depth 0: a line
of quantity q is 0.1 * q metres thick.  Predictions are copies with lines left
out and boundaries moved by fixed rules.  Depths are DECIMAL metres.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEPTH = "decimal(12,2)"
_TIES = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metres(centimetres: Column) -> Column:
    return (centimetres.cast("decimal(14,0)") * F.lit(Decimal("0.01"))).cast(DEPTH)


def reference_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, seq, top, bottom, thickness and the keys that later rules use; one shuffle by document."""
    order = Window.partitionBy("l_orderkey").orderBy(*_TIES)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_TIES, "l_quantity")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.col("l_quantity").cast("long")
    below = F.sum(q).over(upto) * 10
    return lines.select(
        F.col("l_orderkey").alias("doc"), (F.row_number().over(order) - 1).cast("long").alias("seq"), metres(below - q * 10).alias("top"), metres(below).alias("bottom"),
        metres(q * 10).alias("thickness"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").cast("long").alias("ln"),
    )


def predicted_intervals(reference: DataFrame, drop: int, wobble: int) -> DataFrame:
    """The reference without every ``drop``-th supplier and with boundaries moved by up to ``wobble // 2`` steps of 2 cm."""
    moved = lambda depth, key: (F.col(depth) + metres((F.col(key) % wobble - wobble // 2) * 2)).cast(DEPTH)
    return reference.where(F.col("sk") % drop != 0).withColumns({"top": moved("top", "pk"), "bottom": moved("bottom", "sk")})


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """id, x, y, z of suppliers or customers on a modular grid."""
    key, z = {"supplier": ("s_suppkey", "s_acctbal"), "customer": ("c_custkey", "c_acctbal")}[name]
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias("id"), ((k * 37) % 101).cast("double").alias("x"), ((k * 53) % 97).cast("double").alias("y"), F.col(z).alias("z"))


def queries_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("qid"), ((k * 17) % 101).cast("double").alias("qx"), ((k * 29) % 97).cast("double").alias("qy"))


#: The same tables for the SQL oracles.
BASE_SQL = """base AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_tax) - 1 AS seq,
  CAST(l_quantity AS BIGINT) AS q, l_partkey AS pk, l_suppkey AS sk, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem),
cm AS (SELECT doc, seq, pk, sk, ln, q * 10 AS thick, CAST(SUM(q) OVER (PARTITION BY doc ORDER BY seq) AS BIGINT) * 10 AS bot FROM base),
ref AS (SELECT doc, seq, pk, sk, ln, CAST(bot - thick AS DECIMAL(14,0)) * 0.01 AS top, CAST(bot AS DECIMAL(14,0)) * 0.01 AS bottom, CAST(thick AS DECIMAL(14,0)) * 0.01 AS thickness FROM cm),
pa AS (SELECT doc, seq, pk, sk, ln, CAST(bot - thick + (pk % 7 - 3) * 2 AS DECIMAL(14,0)) * 0.01 AS top, CAST(bot + (sk % 7 - 3) * 2 AS DECIMAL(14,0)) * 0.01 AS bottom, CAST(thick AS DECIMAL(14,0)) * 0.01 AS thickness FROM cm WHERE sk % 11 <> 0),
pb AS (SELECT doc, seq, pk, sk, ln, CAST(bot - thick + (pk % 5 - 2) * 2 AS DECIMAL(14,0)) * 0.01 AS top, CAST(bot + (sk % 5 - 2) * 2 AS DECIMAL(14,0)) * 0.01 AS bottom, CAST(thick AS DECIMAL(14,0)) * 0.01 AS thickness FROM cm WHERE sk % 17 <> 0)"""
