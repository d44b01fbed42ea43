"""Resampling and exact tests over per-document counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators._workers import ship_package

#: Documents whose weights are drawn at once.
DRAWN = 512
#: Cumulative Poisson(1) probabilities: the chance of at most 0, 1, 2 ... copies of a document.
COPIES = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8))
_ROUND = 0x45D9F3B


def prf(matched: Column, predicted: Column, referred: Column) -> list[Column]:
    """Pooled precision, recall and F1 with 0 where nothing is counted."""
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return [zero(matched, predicted).alias("precision"), zero(matched, referred).alias("recall"), zero(2 * matched, predicted + referred).alias("f1")]


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix 32-bit numbers (held in 64 bits)."""
    for _ in range(2):
        x = ((x >> 16) ^ x) * _ROUND % (1 << 32)
    return (x >> 16) ^ x


def document_weights(doc: np.ndarray, repetitions: int) -> np.ndarray:
    """How often each document (rows) is drawn in each repetition (columns): Poisson(1) from a hash of both."""
    start = _spread(doc.astype(np.int64) % (1 << 32))
    u = _spread((start[:, None] + np.arange(repetitions, dtype=np.int64)[None, :] * 2654435761) % (1 << 32))
    return np.searchsorted(np.array(COPIES) * (1 << 32), u, "left")


def resampled_sums(counts: DataFrame, columns: list[str], repetitions: int) -> DataFrame:
    """rep and, for each column, its sum over documents drawn with replacement.

    ``counts`` has ``doc`` and a row per document.  Each task adds its
    documents' weighted values to one array of sums per repetition, so rows
    are neither repeated nor shuffled: a task hands on one row a repetition.
    The weights depend on the document and the repetition alone, hence paired
    measures of one document are drawn together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(columns), repetitions))
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float)) for c in batch.columns[1:]])
            for a in range(0, len(doc), DRAWN):
                sums += values[:, a : a + DRAWN] @ document_weights(doc[a : a + DRAWN], repetitions)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(repetitions)), *map(pa.array, sums)], ["rep", *columns])

    long = counts.where("doc is not null").select(F.col("doc").cast("long").alias("doc"), *(F.col(c).cast("double").alias(c) for c in columns))
    ship_package(counts.sparkSession)
    schema = "rep bigint, " + ", ".join(f"{c} double" for c in columns)
    return long.mapInArrow(run, schema).groupBy("rep").agg(*(F.sum(c).alias(c) for c in columns))


def interval(sums: DataFrame, value: Column, name: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Repetitions, mean, percentile interval and share over 0 of a value of the resampled sums (nulls left out)."""
    v = sums.select(value.alias("v"))
    return v.agg(
        F.count("*").alias("repetitions"), F.avg("v").alias(f"mean_{name}"), F.percentile("v", F.lit(low)).alias(f"low_{name}"), F.percentile("v", F.lit(high)).alias(f"high_{name}"),
        F.avg((F.col("v") > 0).cast("double")).alias("positive"),
    )


def bootstrap_f1(counts: DataFrame, repetitions: int = 20_000) -> DataFrame:
    """Percentile interval of pooled F1 over resampled documents (doc, matched, predicted, referred)."""
    sums = resampled_sums(counts, ["matched", "predicted", "referred"], repetitions)
    return interval(sums, prf(F.col("matched"), F.col("predicted"), F.col("referred"))[2], "f1").drop("positive")


def bootstrap_delta(counts: DataFrame, left: Callable[[], Column], right: Callable[[], Column], columns: list[str], repetitions: int = 20_000) -> DataFrame:
    """Percentile interval of the difference of two measures of one draw, and how often it is over 0."""
    return interval(resampled_sums(counts, columns, repetitions), left() - right(), "delta")


def zero_event_bound(n: Column, alpha: float = 0.05) -> Column:
    """Upper bound of a rate of which n trials showed no event; null without trials."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha), F.lit(1.0) / n))


def repeated_summary(rows: DataFrame, value: str, by: tuple[str, ...] = (), z: float = 1.96) -> DataFrame:
    """n, mean, sample deviation (null for one) and mean +- z * deviation / sqrt(n)."""
    n, m, s = F.count(value), F.avg(value), F.stddev_samp(value)
    return rows.groupBy(*by).agg(n.alias("n"), m.alias("mean"), s.alias("deviation"), (m - z * s / F.sqrt(n)).alias("low"), (m + z * s / F.sqrt(n)).alias("high"))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 10 on and by products below."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n >= 10, series).otherwise(F.log(F.factorial(F.greatest(F.least(n, F.lit(10)), F.lit(0)).cast("int")).cast("double")))


def sign_test_p(up: Column, down: Column) -> Column:
    """Exact two-sided p-value of a sign test; null without a sign.

    The tail's terms are summed from the largest on.  Each is at most the one
    before it times k / (n - k + 1), so those left out after 10 standard
    deviations add less than 1e-80 of the sum.
    """
    n, tail = (up + down).cast("double"), F.least(up, down).cast("long")
    largest = F.exp(_log_factorial(up + down) - _log_factorial(tail) - _log_factorial(up + down - tail) - n * math.log(2))
    steps = F.sequence(F.lit(0).cast("long"), F.least(tail, (40 + 10 * F.sqrt(n)).cast("long")))
    start = F.struct(largest.alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        steps, start, lambda acc, j: F.struct((acc["term"] * (tail - j) / (n - tail + j + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum")), lambda acc: acc["sum"]
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2 * total))


def paired_improvement(rows: DataFrame, before: str, after: str, z: float = 1.96) -> DataFrame:
    """Paired differences before - after: counts of signs, mean with its normal interval, relative gain and exact sign test."""
    d = F.col(before).cast("double") - F.col(after).cast("double")
    s = rows.agg(
        F.count(d).alias("n"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("ties"), F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("deviation"), F.sum(d).alias("total"), F.sum(F.when(d.isNotNull(), F.col(before).cast("double"))).alias("whole"),
    )
    half = z * F.col("deviation") / F.sqrt("n")
    return s.select(
        "n", "better", "worse", "ties", "mean", F.when(F.col("n") > 1, F.col("mean") - half).alias("low"), F.when(F.col("n") > 1, F.col("mean") + half).alias("high"),
        F.try_divide("total", F.nullif("whole", F.lit(0.0))).alias("relative"), sign_test_p(F.col("better"), F.col("worse")).alias("p_value"),
    )


def stratum(n: Column) -> Column:
    return F.when(n <= 2, "few").when(n <= 5, "some").otherwise("many")


def profile(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, median, 90th percentile, least and greatest."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"), F.min(value).alias("least"), F.max(value).alias("most"))
