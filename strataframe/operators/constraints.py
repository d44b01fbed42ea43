"""Geological consistency constraints over ordered depth intervals.

Each constraint tells how many cases it looked at and which it found violated;
a case with a missing value isn't looked at.  All interval constraints read one
window over (document, position), so a document's rows are shuffled once.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = Decimal("0.05")


def with_neighbours(intervals: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc").orderBy("seq")
    return intervals.withColumns({"next_top": F.lead("top").over(order), "next_bottom": F.lead("bottom").over(order), "last": F.lead("seq").over(order).isNull()})


def interval_checks(tolerance: Decimal = TOLERANCE) -> dict[str, tuple[Column, Column]]:
    """Name -> (looked at, violated) over rows of :func:`with_neighbours` with final_depth."""
    tol = F.lit(tolerance)
    c = F.col
    gap = c("next_top") - c("bottom")
    return {
        "C1_depth_order": (c("top").isNotNull() & c("bottom").isNotNull(), c("bottom") <= c("top")),
        "C2_thickness": (c("top").isNotNull() & c("bottom").isNotNull() & c("thickness").isNotNull(), F.abs(c("thickness") - (c("bottom") - c("top"))) > tol),
        "C3_gap": (gap.isNotNull(), gap > tol),
        "C3_overlap": (gap.isNotNull(), gap < -tol),
        "C4_monotone": (c("next_top").isNotNull() & c("top").isNotNull() & c("next_bottom").isNotNull() & c("bottom").isNotNull(), (c("next_top") + tol < c("top")) | (c("next_bottom") + tol < c("bottom"))),
        "C5_final_depth": (c("last") & c("bottom").isNotNull() & c("final_depth").isNotNull(), F.abs(c("final_depth") - c("bottom")) > tol),
    }


def violation_counts(intervals: DataFrame, finals: DataFrame, tolerance: Decimal = TOLERANCE) -> DataFrame:
    """Per document and constraint: evaluated, violations, score (null if nothing was looked at) and status."""
    looked = with_neighbours(intervals).join(finals, "doc", "left")
    checks = interval_checks(tolerance)
    rows = F.array(*(F.struct(F.lit(k).alias("constraint"), F.coalesce(e, F.lit(False)).cast("long").alias("e"), F.coalesce(e & v, F.lit(False)).cast("long").alias("v")) for k, (e, v) in checks.items()))
    counted = looked.select("doc", F.explode(rows).alias("r")).groupBy("doc", F.col("r.constraint").alias("constraint")).agg(F.sum("r.e").alias("evaluated"), F.sum("r.v").alias("violations"))
    return counted.select("*", score(F.col("evaluated"), F.col("violations")).alias("score"), status(F.col("evaluated"), F.col("violations")).alias("status"))


def score(evaluated: Column, violations: Column) -> Column:
    return F.when(evaluated > 0, F.greatest(F.lit(0.0), 1 - violations / evaluated))


def status(evaluated: Column, violations: Column) -> Column:
    return F.when(evaluated == 0, "not_evaluated").when(violations == 0, "passed").otherwise("violated")


def consistency(counts: DataFrame) -> DataFrame:
    """Per constraint and over all (``constraint`` null): totals, 1 - violations / evaluated, documents looked at."""
    return counts.rollup("constraint").agg(
        F.sum("evaluated").alias("evaluated"), F.sum("violations").alias("violations"), (1 - F.try_divide(F.sum("violations").cast("double"), F.sum("evaluated").cast("double"))).alias("consistency"),
        F.count_distinct(F.when(F.col("evaluated") > 0, F.col("doc"))).alias("documents"),
    )


def water_checks(boreholes: DataFrame) -> DataFrame:
    """C6 per document: water depth below 0 and water depth under the final depth are two cases."""
    w, f = F.col("water_depth"), F.col("final_depth")
    return boreholes.select(
        "doc", (w.isNotNull().cast("long") + (w.isNotNull() & f.isNotNull()).cast("long")).alias("evaluated"),
        (F.coalesce(w < 0, F.lit(False)).cast("long") + F.coalesce(w > f, F.lit(False)).cast("long")).alias("violations"),
    )


def range_checks(rows: DataFrame, fields: list[str], low: float, high: float) -> DataFrame:
    """C7 per field: values looked at and those outside [low, high]."""
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields))))
    return long.groupBy("field").agg(F.count("value").alias("evaluated"), F.count_if((F.col("value") < low) | (F.col("value") > high)).alias("violations"))


def coordinate_checks(rows: DataFrame, raw: str, least: int = 4, most: int = 12) -> DataFrame:
    """C8: letters that scanners take for digits, and digit counts outside [least, most]; both can hold."""
    digits = F.length(F.regexp_replace(raw, r"\D", ""))
    return rows.select("*", F.col(raw).rlike(r"[0-9][OolIS]|[OolIS][0-9]").alias("confusable"), ((digits < least) | (digits > most)).alias("digit_count"))


#: Circled digits from one on.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩"


def stratum_code(code: Column) -> Column:
    """The number of a simple stratum code: digits alone or one circled digit; null for anything else."""
    text = F.trim(code)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).when(text.rlike(f"^[{CIRCLED}]$"), F.call_function("locate", text, F.lit(CIRCLED)).cast("long"))


def code_sequence(rows: DataFrame) -> DataFrame:
    """C9 per document: over the codes that are simple numbers, repeats and jumps of neighbours.

    Every document gets a row; one with fewer than two such codes has nothing
    evaluated and status ``not_evaluated``.
    """
    ahead = Window.partitionBy("doc").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    parsed = rows.withColumn("number", stratum_code(F.col("code"))).withColumn("next", F.first("number", ignorenulls=True).over(ahead))
    known = F.col("number").isNotNull() & F.col("next").isNotNull()
    per = parsed.groupBy("doc").agg(
        F.count_if(known).alias("evaluated"), F.count_if(known & (F.col("next") == F.col("number"))).alias("repeats"),
        F.count_if(known & (F.col("next") != F.col("number")) & (F.col("next") != F.col("number") + 1)).alias("jumps"),
    )
    return per.withColumn("status", status(F.col("evaluated"), F.col("repeats") + F.col("jumps")))


def type_checks(rows: DataFrame, text: str, number: str) -> DataFrame:
    """C10: a text field that is a number, a number field that isn't one."""
    return rows.select("*", F.col(text).rlike(r"^\s*[-+]?[0-9]+(\.[0-9]+)?\s*$").alias("text_is_number"), (F.col(number).isNotNull() & F.expr(f"try_cast({number} AS decimal(38,12))").isNull()).alias("number_is_text"))
