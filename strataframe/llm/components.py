"""Connected components of an edge table, without collecting it.

Each partition first reduces its edges to a union-find forest; then rounds of
large-star and small-star steps, each one aggregation and one join on the
smaller table of remaining edges, until every node points to its least member.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import materialize, ship_package

#: Edges that a union-find forest takes in before it is emitted.
FOREST_EDGES = 1 << 19


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    seen = 0

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def emit() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield emit()
            parent.clear()
            seen = 0
    if parent:
        yield emit()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours point to a node's least neighbour; small star: smaller ones and itself do."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("least"))
    least = materialize(least, "least-neighbours")  # a join of two tables: a hub's side can be split
    joined = near.join(least, near["u"] == least["node"])
    if large:
        moved = joined.where(F.col("v") > F.col("node")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is its least member.

    ``edges`` has columns u and v (long, not null); loops and repeated or
    reversed edges are allowed.
    """
    ship_package(edges.sparkSession)
    now = materialize(edges.where("u <> v").select("u", "v").mapInArrow(_forest, "u bigint, v bigint").distinct(), "forest")
    mark = lambda df: df.agg(F.count("*"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
    state = mark(now)
    while state[0]:
        now = materialize(_star(_star(now, True), False), "stars")
        was, state = state, mark(now)
        if was == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

