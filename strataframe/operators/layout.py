"""Positioned text regions: lines from words, spatial pairs, tiles, page kinds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strataframe.operators._workers import ship_package


def lines_of_words(words: DataFrame) -> DataFrame:
    """Words (page, line, x0, y0, x1, y1, text, confidence) to lines; negative confidences don't count."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return words.groupBy("page", "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"), F.avg(F.when(F.col("confidence") >= 0, F.col("confidence") / 100)).alias("confidence"),
    )


#: Rows after which a task of :func:`depth_pairs` searches the whole cells it has, and rows of a block of which the largest value is kept.
CELL_ROWS, BLOCK = 200_000, (16, 256, 4096)


def _reach(x: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, near) -> np.ndarray:
    """For each left x the first place from ``low`` to ``high`` whose distance is ``near`` (false, then true)."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        yes = open_ & near(x[np.minimum(mid, len(x) - 1)] - left)
        high = np.where(yes, mid, high)
        low = np.where(open_ & ~yes, mid + 1, low)
    return low


def _nearest_larger(cell: np.ndarray, side: np.ndarray, x: np.ndarray, y: np.ndarray, value: np.ndarray, least_dx: float, most_dx: float, most_dy: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the left side that have a partner, and these partners' rows; rows are in order of cell and x.

    All left rows walk along the right rows of their cell at once; blocks
    without a larger value are passed over in one step.
    """
    right, left = np.flatnonzero(side), np.flatnonzero(~side)
    if not len(right) or not len(left):
        return left[:0], left[:0]
    rx, ry, rv = x[right], y[right], value[right]
    lx, ly, lv = x[left], y[left], value[left]
    first, last = (np.searchsorted(cell[right], cell[left], s) for s in ("left", "right"))
    at, end = _reach(rx, lx, first, last, lambda dx: dx >= least_dx), _reach(rx, lx, first, last, lambda dx: dx > most_dx)
    tops = [np.maximum.reduceat(rv, np.arange(0, len(rv), size)) for size in BLOCK]
    best, best_dx, best_dy = np.full(len(left), -1), np.full(len(left), np.inf), np.full(len(left), np.inf)
    todo = np.flatnonzero(at < end)
    while len(todo):
        p, v = at[todo], lv[todo]
        dx, dy, w = rx[p] - lx[todo], np.abs(ry[p] - ly[todo]), rv[p]
        go = dx <= best_dx[todo]  # beyond the distance found there is nothing nearer
        hit = go & (w > v) & (dy <= most_dy)
        known = best[todo]
        hit &= (known < 0) | (dy < best_dy[todo]) | (dy == best_dy[todo]) & (w < rv[known])
        i = todo[hit]
        best[i], best_dx[i], best_dy[i] = p[hit], dx[hit], dy[hit]
        step = np.ones(len(p), np.int64)
        for size, top in zip(BLOCK, tops, strict=True):
            step[(p % size == 0) & (top[p // size] <= v)] = size
        at[todo] = p + step
        todo = todo[go & (at[todo] < end[todo])]
    found = best >= 0
    return left[found], right[best[found]]


def depth_pairs(numbers: DataFrame, least_dx: float, most_dx: float, most_dy: float) -> DataFrame:
    """Each number with the nearest larger one to its right in the row band.

    ``numbers`` has page, cx, cy, value; distances are those of cx and cy as
    doubles, places that are not finite pair with nothing, and equal rows count
    once.  Rows of a page meet in cells as wide and high as the distances
    allow, and a row looks at those to its right in order until it has found
    the nearest, so pairs that come to nothing are not made.
    """
    ship_package(numbers.sparkSession)
    fields = [numbers.schema[c] for c in ("page", "cx", "cy", "value")]
    out = StructType([*(StructField(f.name, f.dataType) for f in fields[:3]), StructField("top", fields[3].dataType), StructField("bottom", fields[3].dataType)])
    # A little wider than the distances, so that no rounding puts a partner beyond the neighbouring cell.
    wide, high = (1.001 * d if d > 0 else 1.0 for d in (most_dx - least_dx, most_dy))
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in ("cx", "cy")]
    rows = numbers.select("page", "cx", "cy", "value").where(F.col("page").isNotNull() & F.col("value").isNotNull() & finite[0] & finite[1]).distinct()
    whole = lambda c: F.floor(F.greatest(F.least(c, F.lit(9e18)), F.lit(-9e18)))
    column = lambda d=0.0: whole((F.col("cx").cast("double") + F.lit(float(d))) / wide)
    band = whole(F.col("cy").cast("double") / high)
    cells = [F.struct(F.lit(False).alias("side"), column(least_dx).alias("column"), band.alias("band"))]
    cells += [F.struct(F.lit(True).alias("side"), (column() + i).alias("column"), (band + j).alias("band")) for i in (-1, 0) for j in (-1, 0, 1)]
    cell = ["page", "column", "band"]
    dealt = rows.select("page", "cx", "cy", "value", F.inline(F.array(*cells))).repartition(*cell).sortWithinPartitions(*cell, F.col("cx").cast("double"))

    def pairs(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        number = np.concatenate([[0], np.cumsum(_changes(table, cell))])
        place = [table[c].cast(pa.float64()).to_numpy() for c in ("cx", "cy")]
        rank = pc.rank(table["value"].combine_chunks(), "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        a, b = _nearest_larger(number, table["side"].to_numpy(), *place, rank, least_dx, most_dx, most_dy)
        told = table.select(["page", "cx", "cy", "value"]).take(pa.array(a)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(told[c].combine_chunks() for c in told.column_names), table["value"].take(pa.array(b)).combine_chunks()], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            joint = pa.concat_tables([*(t.slice(len(t) - 1) for t in held[-1:]), table])
            ends = np.flatnonzero(_changes(joint, cell)) + (0 if held else 1)
            if len(ends) and size + ends[-1] >= CELL_ROWS:
                yield pairs(pa.concat_tables([*held, table.slice(0, ends[-1])]))
                held, size, table = [], 0, table.slice(ends[-1])
            if len(table):
                held.append(table)
                size += len(table)
        if held:
            yield pairs(pa.concat_tables(held))

    return dealt.mapInArrow(run, out)


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """For each row but the first: whether it differs in these columns from the row before."""
    differ = np.zeros(max(len(table) - 1, 0), bool)
    for c in columns:
        differ |= pc.not_equal(table[c].slice(1), table[c].slice(0, len(differ))).to_numpy()
    return differ


def page_kind(characters: Column, pixels: Column, least_characters: int = 300, least_pixels: int = 1_000_000) -> Column:
    return F.when(characters >= least_characters, "native").when(pixels >= least_pixels, "scanned").when(characters > 0, "native").otherwise("scanned")


def document_kind(pages: DataFrame, doc: str, kind: str = "kind") -> DataFrame:
    return pages.groupBy(doc).agg(F.when(F.count_distinct(kind) > 1, "mixed").otherwise(F.first(kind)).alias("document_kind"), F.count("*").alias("pages"))


def tiles(height: Column, tile: int, overlap: int) -> Column:
    """Starts and ends of overlapping tiles down a page; the last one is cut at its end."""
    starts = F.sequence(F.lit(0), F.greatest(height - overlap - 1, F.lit(0)), F.lit(tile - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + tile, height).alias("end")))


def fit_scale(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of y over x; slopes that aren't positive are null."""
    slope = F.regr_slope(y, x)
    return points.groupBy(group).agg(F.when(slope > 0, slope).alias("slope"), F.when(slope > 0, F.regr_intercept(y, x)).alias("intercept"), F.count("*").alias("n"))


def column_bins(regions: DataFrame, group: str, x: str, width: float) -> DataFrame:
    """The dominant x bin of each group: most distinct values, the leftmost of equal ones."""
    bins = regions.groupBy(group, F.bround(F.col(x) / width).cast("long").alias("bin")).agg(F.count_distinct("value").alias("n"))
    return bins.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "bin"))).where("_p = 1").drop("_p")
