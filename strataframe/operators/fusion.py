"""Agreement of several readings of one field: fusion, adjudication, rereading, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_value(a: Column, b: Column) -> Column:
    """Equal after trimming, as text; null is equal to nothing."""
    return F.trim(a.cast("string")) == F.trim(b.cast("string"))


def fuse(grounded: Column, visual: Column) -> Column:
    """Decision on two readings."""
    return (
        F.when(grounded.isNull() & visual.isNull(), "both_abstained").when(visual.isNull(), "grounded_only").when(grounded.isNull(), "visual_only")
        .when(same_value(grounded, visual), "agreement").otherwise("disagreement")
    )


def adjudicate(a: Column, b: Column, c: Column) -> Column:
    """Status of three readings: c is the corroborating one."""
    return (
        F.when(a.isNull() & b.isNull(), "MISSING").when(same_value(a, b), "AGREEMENT").when(a.isNotNull() & b.isNotNull() & same_value(a, c), "CORROBORATED_A")
        .when(a.isNotNull() & b.isNotNull() & same_value(b, c), "CORROBORATED_B").when(a.isNull(), "SINGLE_SOURCE_B").when(b.isNull(), "SINGLE_SOURCE_A").otherwise("DISAGREEMENT_UNRESOLVED")
    )


#: Confidence of each adjudication status.
STATUS_CONFIDENCE = {"AGREEMENT": 0.98, "CORROBORATED_A": 0.90, "CORROBORATED_B": 0.90, "SINGLE_SOURCE_B": 0.65, "SINGLE_SOURCE_A": 0.65, "DISAGREEMENT_UNRESOLVED": 0.20}


def status_confidence(status: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in STATUS_CONFIDENCE.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def join_readings(keys: list[str], *readings: DataFrame) -> DataFrame:
    """Full outer join of readings that share ``keys`` and have one value column each."""
    out = readings[0]
    for r in readings[1:]:
        out = out.join(r, keys, "full_outer")
    return out


def rank_candidates(candidates: DataFrame, case: str = "case_id") -> DataFrame:
    """Rank of each candidate of a case: 0.45 evidence + 0.20 agreement + 0.35 constraint.

    Agreement is the share of the case's sources that give the value;
    constraint is 1, 0.5 or 0 as the candidate lowers, keeps or raises the
    number of violations.  Ties keep the input's ``place``.
    """
    sources = candidates.groupBy(F.col(case).alias("s_case")).agg(F.count_distinct("source").alias("sources"))
    backers = candidates.groupBy(F.col(case).alias("b_case"), F.col("value").alias("b_value")).agg(F.count_distinct("source").alias("backers"))
    known = candidates.join(sources, F.col(case) == F.col("s_case")).join(backers, (F.col(case) == F.col("b_case")) & F.col("value").eqNullSafe(F.col("b_value")))
    constraint = F.when(F.col("violation_change") < 0, 1.0).when(F.col("violation_change") == 0, 0.5).otherwise(0.0)
    score = F.coalesce("evidence", F.lit(0.0)) * 0.45 + F.col("backers") / F.col("sources") * 0.20 + constraint * 0.35
    scored = known.withColumn("score", F.round(score, 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("score"), "place"))).drop("s_case", "b_case", "b_value")


def decide_reread(ranked: DataFrame, case: str = "case_id", least_score: float = 0.75, least_margin: float = 0.10) -> DataFrame:
    """Decision of each case on its ranked candidates."""
    per_source = ranked.groupBy(case, "source").agg(F.count_distinct("value").alias("v")).groupBy(F.col(case).alias("m_case")).agg(F.max("v").alias("most"))
    best = ranked.where("rank = 1").select(F.col(case), F.col("value").alias("best_value"), F.col("score").alias("best_score"), "violation_change")
    second = ranked.join(best.select(F.col(case).alias("t_case"), "best_value"), (F.col(case) == F.col("t_case")) & ~F.col("value").eqNullSafe(F.col("best_value"))).groupBy("t_case").agg(F.max("score").alias("second"))
    row = best.join(per_source, F.col(case) == F.col("m_case")).join(second, F.col(case) == F.col("t_case"), "left")
    margin = F.coalesce(F.col("best_score") - F.col("second"), F.lit(1.0))
    decision = (
        F.when(F.col("most") > 1, "CONFLICTING_SOURCE").when(F.col("violation_change") >= 0, "NO_VIOLATION_REDUCTION").when(F.col("best_score") < least_score, "LOW_SCORE")
        .when(F.round(margin, 9) < least_margin, "LOW_MARGIN").otherwise("ACCEPT")
    )
    return row.select(case, "best_value", "best_score", decision.alias("decision"))


def review_queue(fields: DataFrame, violations: DataFrame) -> DataFrame:
    """Documents to review with sorted reason codes and a priority.

    ``fields`` has doc, field, value, confidence and required; ``violations``
    has doc and code.  High: something required is missing or three reasons or
    more; medium: a constraint is violated; else low.
    """
    reason = F.when(F.col("value").isNull() & F.col("required"), F.concat(F.lit("missing:"), F.col("field"))).when(F.col("value").isNotNull() & (F.col("confidence") < 0.7), F.concat(F.lit("low_confidence:"), F.col("field")))
    all_reasons = fields.select("doc", reason.alias("reason")).where("reason is not null").unionByName(violations.select("doc", F.concat(F.lit("constraint:"), F.col("code")).alias("reason")))
    per = all_reasons.groupBy("doc").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    missing = F.exists("reasons", lambda r: r.startswith("missing:")) | (F.size("reasons") >= 3)
    broken = F.exists("reasons", lambda r: r.startswith("constraint:"))
    return per.select("doc", F.array_join("reasons", ";").alias("reasons"), F.when(missing, "high").when(broken, "medium").otherwise("low").alias("priority"))
