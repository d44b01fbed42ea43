"""Group-disjoint splits, hash folds, orders and record hashes."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(value: Column, salt: str = "") -> Column:
    """The first 32 bits of a salted SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def fold(value: Column, folds: int, salt: str = "") -> Column:
    return F.pmod(hash_number(value, salt), F.lit(folds)).cast("int")


#: Groups of one size beyond which their places are numbered in blocks of hashes, so that no task sorts all of them.
LARGE_GROUPS = 10_000


def _turns(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[int, list[str]]]]:
    """For each size, largest first: from which place on its groups go to which splits in turn.

    Placing one by one among ``m`` groups of one size ``n`` takes ``n`` off a
    lack at a time.  Lacks are told apart as ``q * n + r``: each split takes
    one group at every level up to its ``q``, in the same order at all levels,
    so one list of splits holds from each ``q`` down to the next.
    """
    total, counts, turns = sum(n * m for n, m in sizes), dict.fromkeys(shares, 0), {}
    targets = {s: Fraction(str(share)) * total for s, share in shares.items()}
    for n, m in sorted(sizes, reverse=True):
        level = {s: (targets[s] - counts[s]) // n for s in shares}
        order = sorted(shares, key=lambda s: (counts[s] - targets[s] + level[s] * n, counts[s] + level[s] * n))
        steps, place = [], 0
        tops = sorted(set(level.values()), reverse=True)
        for top, following in zip(tops, [*tops[1:], None], strict=True):
            if place >= m:
                break
            active = [s for s in order if level[s] >= top]
            taken = m - place if following is None else min((top - following) * len(active), m - place)
            for i, s in enumerate(active):
                counts[s] += n * (taken // len(active) + (i < taken % len(active)))
            steps.append((place, active))
            place += taken
        turns[n] = steps
    return turns


def balanced_split(rows: DataFrame, group: str, shares: dict[str, float], salt: str = "") -> DataFrame:
    """``rows`` with ``split``: whole groups, the largest first, each to the split that is most under its target.

    Groups are placed one by one in order of size, then of their salted hash;
    the split of least count less target takes one, of equal ones that of
    least count, then the first named.  Where a group goes follows from its
    size and its place among the groups of that size, so the driver holds the
    distinct sizes only.  Shares must add up to 1.  A null group is refused.
    """
    if not shares or min(shares.values()) < 0 or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must be non-negative and sum to 1")
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    told = sizes.groupBy("_n").agg(F.count("*").alias("m"), F.count_if(F.col("_group").isNull()).alias("missing")).collect()
    if any(r["missing"] for r in told):
        raise ValueError(f"rows without the group {group}")
    many = {r["_n"]: r["m"] for r in told}
    turns = [(n, -(-many[n] // LARGE_GROUPS), steps) for n, steps in _turns(list(many.items()), shares).items()]
    known = F.broadcast(rows.sparkSession.createDataFrame(turns, "_size long, _blocks long, _steps array<struct<start: long, splits: array<string>>>"))
    groups = sizes.withColumn("_h", hash_number(F.col("_group"), salt)).join(known, F.col("_n") == F.col("_size")).withColumn("_block", F.shiftright(F.col("_h") * F.col("_blocks"), 32))
    # A group's place: the groups of its size in earlier blocks, and those before it in its own.
    blocks = groups.groupBy(F.col("_size").alias("_b_size"), F.col("_block").alias("_b_block")).agg(F.count("*").alias("_m"))
    earlier = Window.partitionBy("_b_size").orderBy("_b_block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("_b_size", "_b_block", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_size", "_block").orderBy("_h", "_group")) - 1
    placed = groups.withColumn("_within", within).join(first, (F.col("_size") == F.col("_b_size")) & (F.col("_block") == F.col("_b_block"))).withColumn("_place", F.col("_first") + F.col("_within"))
    step = placed.withColumn("_step", F.element_at(F.filter("_steps", lambda x: x["start"] <= F.col("_place")), -1))
    to = F.get("_step.splits", (F.col("_place") - F.col("_step.start")) % F.size("_step.splits"))
    placed = step.select("_group", to.alias("_to"))
    return rows.join(placed, F.col(group) == F.col("_group")).withColumn("split", F.col("_to")).drop("_group", "_to")


def split_manifest(split: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per split: rows and groups, beside the hash of all records."""
    return split.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups")).join(F.broadcast(manifest_hash(split, columns)))


def group_split(rows: DataFrame, group: str, shares: dict[str, float], salt: str = "") -> DataFrame:
    """``rows`` with ``split``: whole groups, dealt along the unit interval by their hash.

    The place of a group depends on nothing but its key, so splits stay as
    they are when rows are added and no order over all groups is needed.
    :func:`balanced_split` meets the shares more closely.
    """
    u = hash_number(F.col(group), salt) / F.lit(4294967296.0)
    edge, out = 0.0, F.lit(list(shares)[-1])
    steps = []
    for name, share in shares.items():
        edge += share
        steps.append((name, edge))
    for name, edge in reversed(steps[:-1]):
        out = F.when(u < edge, name).otherwise(out)
    return rows.withColumn("split", out)


def leaks(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def round_robin(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """``rows`` with ``turn``: its number within its source; sort by (turn, source) to interleave."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order)))


def exclude(rows: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    return rows.join(earlier.select(F.col(key)).distinct(), key, "left_anti")


def canonical_json(columns: list[str]) -> Column:
    """One JSON text of the named columns: keys in order, no spaces, nulls told."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def record_hash(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the named columns."""
    return F.sha2(canonical_json(columns).cast("binary"), 256)


def manifest_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a hash of all records, whatever their order, and their number.

    Records are hashed where they lie; sorted hashes are hashed in 4,096
    blocks by their first digits, and the blocks' hashes in order, so no task
    holds all records.
    """
    hashed = rows.select(record_hash(columns).alias("h"))
    blocks = hashed.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n").cast("binary"), 256).alias("d"), F.count("*").alias("n"))
    return blocks.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "d"))), "\n").cast("binary"), 256).alias("manifest_sha256"), F.sum("n").alias("records"))
