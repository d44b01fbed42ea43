"""Interval matching and its metrics."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.operators._workers import ship_package


def ratio(top: Column, below: Column) -> Column:
    """Quotient as double, null where nothing is counted."""
    return F.try_divide(top.cast("double"), below.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; null if both are null, 0 if both are 0."""
    return F.when(precision.isNull() & recall.isNull(), None).when(F.coalesce(precision, F.lit(0.0)) + F.coalesce(recall, F.lit(0.0)) == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def band_pairs(reference: DataFrame, prediction: DataFrame, tolerance: str) -> DataFrame:
    """Pairs of one document whose tops and bottoms both lie within the tolerance (inclusive)."""
    tol = F.lit(Decimal(tolerance))
    # Depths meet by cells, so a document's intervals aren't all held against each other; a prediction that lies
    # within the tolerance of a cell's edge is in both cells.
    reach = float(tolerance) * 1.001 + 1e-9
    cell = lambda c, by=0.0: F.floor((F.col(c).cast("double") + by) / max(20 * reach, 0.5))
    p = prediction.select(F.col("doc").alias("p_doc"), F.col("seq").alias("p_seq"), F.col("top").alias("p_top"), F.col("bottom").alias("p_bottom"), F.explode(F.array_distinct(F.array(cell("top", -reach), cell("top", reach)))).alias("p_cell"))
    near = (F.col("doc") == F.col("p_doc")) & (cell("top") == F.col("p_cell")) & (F.abs(F.col("top") - F.col("p_top")) <= tol) & (F.abs(F.col("bottom") - F.col("p_bottom")) <= tol)
    return reference.join(p, near).select("doc", F.col("seq").alias("r_seq"), "p_seq", (F.abs(F.col("top") - F.col("p_top"))).alias("top_error"), (F.abs(F.col("bottom") - F.col("p_bottom"))).alias("bottom_error"))


def _best_path(pairs: list[tuple[int, int, Decimal]]) -> list[tuple[int, int]]:
    """Order-preserving pairs: most first, then least error; leaving a line out wins ties."""
    rows, columns = sorted({a for a, _, _ in pairs}), sorted({b for _, b, _ in pairs})
    at_row, at_column = {v: k + 1 for k, v in enumerate(rows)}, {v: k + 1 for k, v in enumerate(columns)}
    cost = {(at_row[a], at_column[b]): e for a, b, e in pairs}
    best = {(i, j): (0, Decimal(0)) for i in range(len(rows) + 1) for j in range(len(columns) + 1)}
    step: dict[tuple[int, int], str] = {}
    for i in range(1, len(rows) + 1):
        for j in range(1, len(columns) + 1):
            best[i, j], step[i, j] = best[i - 1, j], "row"
            if best[i, j - 1] > best[i, j]:
                best[i, j], step[i, j] = best[i, j - 1], "column"
            if (i, j) in cost:
                n, e = best[i - 1, j - 1]
                if (n + 1, e - cost[i, j]) > best[i, j]:
                    best[i, j], step[i, j] = (n + 1, e - cost[i, j]), "both"
    i, j, out = len(rows), len(columns), []
    while i and j:
        if step[i, j] == "both":
            out.append((rows[i - 1], columns[j - 1]))
        i, j = i - (step[i, j] != "column"), j - (step[i, j] != "row")
    return out[::-1]


def match_intervals(reference: DataFrame, prediction: DataFrame, tolerance: str) -> DataFrame:
    """Order-preserving one-to-one matches of each document: doc, r_seq, p_seq, errors.

    Documents whose band pairs are one-to-one and in order are matched by the
    join alone; only the others go to the path search, a row each, in batches.
    """
    pairs = band_pairs(reference, prediction, tolerance)
    ordered = F.array_sort(F.collect_list(F.struct("r_seq", "p_seq", "top_error", "bottom_error")))
    docs = pairs.groupBy("doc").agg(ordered.alias("pairs"))
    ties = F.exists(F.zip_with(F.slice("pairs", 1, F.size("pairs") - 1), F.slice("pairs", 2, F.size("pairs") - 1), lambda a, b: (a["r_seq"] >= b["r_seq"]) | (a["p_seq"] >= b["p_seq"])), lambda x: x)
    docs = docs.withColumn("ties", (F.size("pairs") > 1) & ties)
    ship_package(docs.sparkSession)
    plain = docs.where("not ties").select("doc", F.inline("pairs"))
    columns = plain.columns

    def paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, pairs in zip(frame["doc"], frame["pairs"], strict=True):
                chosen = set(_best_path([(p["r_seq"], p["p_seq"], p["top_error"] + p["bottom_error"]) for p in pairs]))
                out += [(doc, *(p[c] for c in columns[1:])) for p in pairs if (p["r_seq"], p["p_seq"]) in chosen]
            yield pd.DataFrame(out, columns=columns)

    return plain.unionByName(docs.where("ties").select("doc", "pairs").mapInPandas(paths, plain.schema))


def interval_metrics(reference: DataFrame, prediction: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: tp, refs, preds, micro precision, recall and F1, mean boundary errors."""
    counts = matches.agg(F.count("*").alias("tp"), F.avg("top_error").cast("double").alias("top_mae"), F.avg("bottom_error").cast("double").alias("bottom_mae"))
    sides = reference.agg(F.count("*").alias("refs")).join(prediction.agg(F.count("*").alias("preds")))
    both = counts.join(sides)
    p, r = ratio(F.col("tp"), F.col("preds")), ratio(F.col("tp"), F.col("refs"))
    return both.select("tp", "refs", "preds", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), "top_mae", "bottom_mae")
