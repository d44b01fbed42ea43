"""Confidence: fusion, calibration measures, temperature and threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.matching import ratio


def fuse_confidence(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that aren't null, weights renormalised; null if all are."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    below = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return F.try_divide(top, below)


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, edge: float) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def reliability(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-width bins: n, mean confidence, accuracy; empty bins are left out."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def expected_calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: ece and n, from the bins' partial sums."""
    b = reliability(rows, p, y, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def temperature_grid(rows: DataFrame, p: str, y: str, low: float = 0.05, high: float = 10.0, step: float = 0.05, edge: float = 1e-6) -> DataFrame:
    """Log loss at each temperature of the grid, all in one pass over the rows.

    Losses of a row at all temperatures are summed element by element, so no
    row is repeated for the grid.
    """
    count = round((high - low) / step) + 1
    q = F.greatest(F.least(F.col(p), F.lit(1 - edge)), F.lit(edge))
    odds = F.log(q / (1 - q))
    temps = [low + k * step for k in range(count)]
    losses = [F.avg(F.log1p(F.exp(-F.when(F.col(y) == 1, F.col("o")).otherwise(-F.col("o")) / t))) for t in temps]
    one = rows.select(odds.alias("o"), y).agg(F.array(*losses).alias("loss"))
    return one.select(F.posexplode("loss").alias("step", "loss")).select((F.lit(low) + F.col("step") * step).alias("temperature"), "loss")


def fit_temperature(rows: DataFrame, p: str, y: str) -> DataFrame:
    """The temperature of least loss, the first of equal ones."""
    return temperature_grid(rows, p, y).orderBy("loss", "temperature").limit(1)


def threshold_curve(rows: DataFrame, p: str, y: str, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy of the rows at or over each threshold, in one pass."""
    parts = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(p) >= t).alias("accepted"), F.count_if((F.col(p) >= t) & (F.col(y) == 1)).alias("correct"), F.count("*").alias("n")) for t in thresholds]
    one = rows.agg(F.array(*parts).alias("t")).select(F.inline("t"))
    return one.select("threshold", "accepted", "correct", ratio(F.col("accepted"), F.col("n")).alias("coverage"), ratio(F.col("correct"), F.col("accepted")).alias("accuracy"))


def running_counts(per: DataFrame, order: str, sums: list[str], cells: int = 64) -> DataFrame:
    """``per`` with each of ``sums`` replaced by its running total from the greatest ``order`` down.

    Distinct scores are dealt into ranges of about equal size; totals run
    within a range, and those of the ranges above, one row each, are added.
    """
    edges = per.agg(F.percentile_approx(order, [k / cells for k in range(1, cells)], 1000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    cell = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col(order) >= e)) if edges else F.lit(0)
    dealt = per.withColumn("_cell", cell)
    down = Window.partitionBy("_cell").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("_cell").alias("_c")).agg(*(F.sum(c).alias(c) for c in sums))
    totals = totals.select("_c", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above_{c}") for c in sums))  # one row a range
    inside = dealt.select("_cell", order, *(F.sum(c).over(down).alias(c) for c in sums))
    return inside.join(F.broadcast(totals), F.col("_cell") == F.col("_c")).select(order, *((F.col(c) + F.col(f"_above_{c}")).alias(c) for c in sums))


def select_threshold(rows: DataFrame, p: str, y: str, least_accuracy: float) -> DataFrame:
    """The score whose acceptance is most rows at the accuracy; ties by accuracy, then score.

    Rows are counted per distinct score first; running sums go over ranges of
    those in parallel.
    """
    per = rows.groupBy(F.col(p).alias("threshold")).agg(F.count("*").alias("accepted"), F.sum(F.col(y).cast("long")).alias("correct"))
    sums = running_counts(per, "threshold", ["accepted", "correct"])
    fits = sums.withColumn("accuracy", F.col("correct") / F.col("accepted")).where(F.col("accuracy") >= least_accuracy)
    return fits.orderBy(F.desc("accepted"), F.desc("accuracy"), F.desc("threshold")).limit(1)
