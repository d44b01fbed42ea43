"""Errors put into ordered boundaries, and what they do to surfaces and topology.

A record is a row: doc, x, y, collar and ``depths``, an array of boundary
depths in order in which a null is a missing one.  Draws come from hashes of a
seed and the record, so they are the same on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators import spatial
from strataframe.operators.splits import hash_number

#: The classes of errors.
ERROR_CLASSES = ("boundary_shift", "coordinate_shift", "missing_boundary", "merged_layer", "split_layer", "duplicate_boundary")


def unit(key: Column, salt: str) -> Column:
    """A number in [0, 1) from a key and a salt."""
    return hash_number(key, salt) / F.lit(4294967296.0)


def _chosen(rows: DataFrame, share: float, seed: int, key: Column) -> DataFrame:
    """The rows of least hash: a share of them, one at least, all at most."""
    if not 0 < share <= 1:
        raise ValueError("the share of affected rows must lie in (0, 1]")
    n = rows.count()
    take = min(n, max(1, round(n * share)))
    return rows.withColumn("_u", hash_number(key, f"{seed}:pick:")).orderBy("_u", key).limit(take).drop("_u") if n else rows


def inject(records: DataFrame, error: str, parameter: float, seed: int, share: float = 0.25) -> DataFrame:
    """``records`` with one class of errors put in, and ``operation``, ``place`` (1-based) and ``change`` of what was done.

    Shifts move by ``parameter`` metres in a ``share`` of the boundaries that
    have room or of the records; the other classes change a share
    ``parameter`` of the records that can have them.  Untouched records have a
    null operation.
    """
    if error not in ERROR_CLASSES:
        raise ValueError(f"no such class of errors: {error}")
    if parameter <= 0:
        raise ValueError("the parameter must be positive")
    u = lambda what: unit(F.col("doc").cast("string"), f"{seed}:{what}:")
    d, n = F.col("depths"), F.size("depths")
    columns = records.columns
    if error == "boundary_shift":
        each = records.select("doc", F.posexplode("depths").alias("i", "v"), "depths").where("v is not null")
        before = F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.get("depths", F.col("i") - 1))
        up = F.coalesce(F.col("v") - parameter > before, F.lit(False))
        after = F.get("depths", F.col("i") + 1)
        down = after.isNull() | (F.col("v") + parameter < after)
        key = F.concat_ws("/", F.col("doc").cast("string"), F.col("i").cast("string"))
        fit = each.select("doc", "i", up.alias("up"), down.alias("down"), key.alias("k")).where("up or down")
        side = F.when(F.col("up") & F.col("down"), F.when(unit(F.col("k"), f"{seed}:side:") < 0.5, -1).otherwise(1)).when(F.col("up"), -1).otherwise(1)
        picked = _chosen(fit, share, seed, F.col("k")).groupBy(F.col("doc").alias("p_doc")).agg(F.array_sort(F.collect_list(F.struct("i", (side * parameter).alias("by")))).alias("moves"))
        moved = lambda v, i: v + F.coalesce(F.get(F.transform(F.filter("moves", lambda m: m["i"] == i), lambda m: m["by"]), F.lit(0)), F.lit(0.0))
        out = records.join(picked, F.col("doc") == F.col("p_doc"), "left").withColumn("depths", F.when(F.col("moves").isNotNull(), F.transform(d, moved)).otherwise(d))
        first = F.get("moves", F.lit(0))
        return out.select(*columns, F.when(F.col("moves").isNotNull(), error).alias("operation"), (first["i"] + 1).alias("place"), first["by"].alias("change"))
    least = {"coordinate_shift": 0, "merged_layer": 2}.get(error, 1)
    fit = records.where(n >= least)
    picked = _chosen(fit.select("doc"), share if error == "coordinate_shift" else parameter, seed, F.col("doc").cast("string")).select(F.col("doc").alias("p_doc"))
    joined = records.join(picked, F.col("doc") == F.col("p_doc"), "left")
    hit = F.col("p_doc").isNotNull()
    if error == "coordinate_shift":
        angle = u("angle") * 2 * math.pi
        moved = {"x": F.when(hit, F.col("x") + parameter * F.cos(angle)).otherwise(F.col("x")), "y": F.when(hit, F.col("y") + parameter * F.sin(angle)).otherwise(F.col("y"))}
        return joined.select(*(moved.get(c, F.col(c)).alias(c) for c in columns), F.when(hit, error).alias("operation"), F.lit(None).cast("int").alias("place"), F.when(hit, F.lit(parameter)).alias("change"))
    slots = n - 1 if error == "merged_layer" else n
    at = F.floor(u("place") * slots).cast("int")
    here = F.get("depths", at)
    head, tail = F.slice(d, 1, at), lambda skip: F.slice(d, at + 1 + skip, F.greatest(n - at - skip, F.lit(0)))
    top = F.when(at == 0, F.lit(0.0)).otherwise(F.get("depths", at - 1))
    none = F.lit(None).cast("double")
    new, change = {
        "missing_boundary": (F.concat(head, F.array(none), tail(1)), here), "merged_layer": (F.concat(head, tail(1)), here),
        "split_layer": (F.concat(head, F.array((top + here) / 2), tail(0)), (top + here) / 2), "duplicate_boundary": (F.concat(head, F.array(here), tail(0)), here),
    }[error]
    return joined.withColumns({"_new": new, "_change": change, "_place": at + 1}).select(
        *((F.when(hit, F.col("_new")).otherwise(F.col(c)) if c == "depths" else F.col(c)).alias(c) for c in columns), F.when(hit, error).alias("operation"), F.when(hit, F.col("_place")).alias("place"), F.when(hit, F.col("_change")).alias("change"),
    )


def perturb(intervals: DataFrame, magnitude: float, seed: int) -> DataFrame:
    """Intervals (doc, seq, top, bottom) whose shared inner boundaries move up or down by ``magnitude``; thickness follows.

    The first top and the last bottom stay.
    """
    if magnitude < 0:
        raise ValueError("the magnitude must not be negative")
    order = Window.partitionBy("doc").orderBy("seq")
    key = F.concat_ws("/", F.col("doc").cast("string"), F.col("seq").cast("string"))
    inner = F.lead("seq").over(order).isNotNull()
    moved = intervals.withColumn("_by", F.when(inner, F.when(unit(key, f"{seed}:") < 0.5, -magnitude).otherwise(magnitude)).otherwise(0.0))
    bottom = F.when(inner, F.col("bottom").cast("double") + F.col("_by")).otherwise(F.col("bottom").cast("double"))
    moved = moved.withColumn("_bottom", bottom).withColumn("_top", F.coalesce(F.lag("_bottom").over(order), F.col("top").cast("double")))
    keep = [c for c in intervals.columns if c not in ("top", "bottom", "thickness")]
    return moved.select(*keep, F.col("_top").alias("top"), F.col("_bottom").alias("bottom"), (F.col("_bottom") - F.col("_top")).alias("thickness"))


def corrupt(points: DataFrame, magnitude: float, rate: float, seed: int) -> DataFrame:
    """Points (id, x, y, z) of which each is moved up or down by ``magnitude`` with chance ``rate``; ``corrupted`` tells which."""
    hit = unit(F.col("id").cast("string"), f"{seed}:hit:") < rate
    side = F.when(unit(F.col("id").cast("string"), f"{seed}:side:") < 0.5, -magnitude).otherwise(magnitude)
    return points.withColumn("corrupted", hit).withColumn("z", F.col("z") + F.when(F.col("corrupted"), side).otherwise(0.0))


def boundary_points(records: DataFrame, boundary: int) -> DataFrame:
    """Surface points (id, x, y, z) of a boundary (0-based): collar less depth, of records that have all of them."""
    z = F.col("collar") - F.get("depths", F.lit(boundary))
    return records.select(F.col("doc").alias("id"), "x", "y", z.alias("z")).where("x is not null and y is not null and z is not null")


def surface_points(intervals: DataFrame, boreholes: DataFrame, boundary: str = "bottom") -> DataFrame:
    """seq, id, x, y, z of every interval's boundary: the borehole's collar less the depth, nulls left out."""
    b = boreholes.select(F.col("doc").alias("b_doc"), "x", "y", "collar")
    z = F.col("collar").cast("double") - F.col(boundary).cast("double")
    return intervals.join(b, F.col("doc") == F.col("b_doc")).select("seq", F.col("doc").alias("id"), "x", "y", z.alias("z")).where("x is not null and y is not null and z is not null")


def topology(reference: DataFrame, prediction: DataFrame) -> DataFrame:
    """Per document: differences in number, missing slots, falls in order and places that differ; a document with any is mismatched."""
    p = prediction.select(F.col("doc").alias("p_doc"), F.col("depths").alias("found"))
    both = reference.select("doc", "depths").join(p, F.col("doc") == F.col("p_doc"))
    known = F.filter("found", lambda x: x.isNotNull())
    falls = F.size(F.filter(F.zip_with(known, F.slice(known, 2, F.greatest(F.size(known), F.lit(1))), lambda a, b: b <= a), lambda x: F.coalesce(x, F.lit(False))))
    missing = F.size("found") - F.size(known)
    wrong = F.size(F.filter(F.transform("depths", lambda v, i: F.coalesce(F.abs(F.get("found", i) - v) > 1e-9, F.lit(True))), lambda x: x))
    told = both.select("doc", F.abs(F.size(known) - F.size("depths")).alias("count_difference"), missing.alias("missing_slots"), falls.alias("falls"), wrong.alias("misplaced"))
    return told.withColumn("mismatched", (F.col("count_difference") > 0) | (F.col("missing_slots") > 0) | (F.col("falls") > 0))


def boundary_errors(reference: DataFrame, prediction: DataFrame) -> DataFrame:
    """Per boundary (1-based): reference and predicted points, coverage and mean absolute depth error."""
    r = reference.select("doc", F.posexplode("depths").alias("i", "v")).where("v is not null")
    p = prediction.select(F.col("doc").alias("p_doc"), F.posexplode("depths").alias("p_i", "p_v")).where("p_v is not null")
    both = r.join(p, (F.col("doc") == F.col("p_doc")) & (F.col("i") == F.col("p_i")), "left")
    return both.groupBy((F.col("i") + 1).alias("boundary")).agg(
        F.count("*").alias("reference_points"), F.count("p_v").alias("predicted_points"), (F.count("p_v") / F.count("*")).alias("coverage"), F.avg(F.abs(F.col("p_v") - F.col("v"))).alias("mae"),
    )


def surface_errors(reference: DataFrame, prediction: DataFrame, boundary: int, queries: DataFrame) -> DataFrame:
    """Errors of a boundary's predicted surface against the reference's at the queries (qid, qx, qy).

    Predicted points count only for records whose reference has the boundary.
    """
    ref = boundary_points(reference, boundary)
    pred = boundary_points(prediction, boundary).join(ref.select(F.col("id").alias("r_id")), F.col("id") == F.col("r_id"), "left_semi")
    a, b = spatial.idw(queries, ref), spatial.idw(queries, pred).withColumnsRenamed({"qid": "b_qid", "z": "b_z"})
    return spatial.error_summary(a.join(b, F.col("qid") == F.col("b_qid")).select((F.col("b_z") - F.col("z")).alias("e")), "e")


def centred(points: DataFrame, degrees: float = 17.0) -> DataFrame:
    """Points without their place: moved to their centre, turned, heights less their mean."""
    mean = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return points.join(F.broadcast(mean)).select("id", (x * c - y * s).alias("x"), (x * s + y * c).alias("y"), (F.col("z") - F.col("mz")).alias("z"))


def jackknife(queries: DataFrame, points: DataFrame, area: float, power: float = 2.0) -> DataFrame:
    """id and volume of the surface over the queries with each point left out in turn.

    Each query's two sums over all points are taken once; leaving a point out
    takes its own share off them, so nothing is computed anew per point.
    """
    d2 = (F.col("qx") - F.col("x")) ** 2 + (F.col("qy") - F.col("y")) ** 2
    near = spatial._beside(queries, points).withColumn("d2", d2)
    w = F.when(F.col("d2") > 0, F.pow("d2", F.lit(-power / 2)))
    per = near.withColumns({"w": w, "wz": w * F.col("z"), "c": F.when(F.col("d2") == 0, 1).otherwise(0), "cz": F.when(F.col("d2") == 0, F.col("z")).otherwise(0.0)})
    whole = per.groupBy(F.col("qid").alias("s_qid")).agg(*(F.sum(c).alias(f"s_{c}") for c in ("w", "wz", "c", "cz")))
    both = per.join(whole, F.col("qid") == F.col("s_qid"))
    left = lambda c: F.col(f"s_{c}") - F.coalesce(F.col(c), F.lit(0.0))
    z = F.when(left("c") > 0, left("cz") / left("c")).otherwise(left("wz") / left("w"))
    return both.groupBy("id").agg((F.avg(z) * area).alias("volume"))
