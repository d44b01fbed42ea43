"""Gates, audits and agreement of readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items())))


def gate(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows`` with the ``reasons`` against each and ``eligible`` where there are none."""
    return rows.withColumn("reasons", reasons(checks)).withColumn("eligible", F.size("reasons") == 0)


def reason_histogram(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("reasons").alias("reason")).groupBy(F.substring_index("reason", ":", 1).alias("reason")).agg(F.count("*").alias("n"))


def agreement(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two readers over the same keys: in both, in one alone, equal, unequal."""
    a = first.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
    b = second.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, keys, "full_outer").agg(
        F.count_if(both).alias("both"), F.count_if(F.col("_in_b").isNull()).alias("first_only"), F.count_if(F.col("_in_a").isNull()).alias("second_only"), F.count_if(both & same).alias("equal"), F.count_if(both & ~same).alias("unequal"),
    )


def coverage_guard(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing, unexpected or repeated."""
    n = found.groupBy(*keys).agg(F.count("*").alias("found"))
    e = expected.select(*keys).distinct().withColumn("expected", F.lit(1))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("found") > 1, "repeated")
    return e.join(n, keys, "full_outer").select(*keys, problem.alias("problem")).where("problem is not null")


def merge_first(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the first value that isn't null, and whether there were several."""
    first = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    several = [(F.count_distinct(f) > 1).alias(f"{f}_conflict") for f in fields]
    return rows.groupBy(key).agg(*first, *several)


def pseudonym(value: Column, salt: str) -> Column:
    """The first 20 hex digits of the salted hash."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")).cast("binary"), 256), 1, 20)


def funnel(rows: DataFrame, steps: dict[str, Column], doc: str) -> DataFrame:
    """Documents and rows left after each successive filter, from one pass."""
    so_far, parts = F.lit(True), []
    for k, (name, keep) in enumerate(steps.items()):
        so_far = so_far & F.coalesce(keep, F.lit(False))
        parts.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("name"), F.count_distinct(F.when(so_far, F.col(doc))).alias("documents"), F.count_if(so_far).alias("rows")))
    return rows.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def all_gates(gates: DataFrame) -> DataFrame:
    """One row of named gates with ``ready``: all of them hold."""
    held = [F.coalesce(F.col(c), F.lit(False)) for c in gates.columns]
    out = F.lit(True)
    for h in held:
        out = out & h
    return gates.withColumn("ready", out)
