"""Readers and writers of interval records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "struct<value: string, source_page: int, source_text: string, extraction_method: string, confidence: double, validation_status: string, warning_codes: array<string>>"
RECORD = f"document_id string, final_depth_m {ENVELOPE}, intervals array<struct<top_depth_m: {ENVELOPE}, bottom_depth_m: {ENVELOPE}, lithology: {ENVELOPE}>>"


def envelope(value: Column, page: Column | None = None, method: str = "unknown", confidence: Column | None = None) -> Column:
    """A value with its evidence; not validated, without warnings."""
    none = F.lit(None)
    return F.struct(
        value.cast("string").alias("value"), (none if page is None else page).cast("int").alias("source_page"), none.cast("string").alias("source_text"), F.lit(method).alias("extraction_method"),
        (none if confidence is None else confidence).cast("double").alias("confidence"), F.lit("not_validated").alias("validation_status"), F.array().cast("array<string>").alias("warning_codes"),
    )


def nest(intervals: DataFrame, change: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Records of documents from their interval rows (doc, seq, top, bottom, lithology).

    ``change`` may name a column and what becomes of its envelope.
    """
    made = {c: (change or {}).get(c, lambda e: e)(envelope(F.col(c))) for c in ("top", "bottom", "lithology")}
    one = F.struct("seq", made["top"].alias("top_depth_m"), made["bottom"].alias("bottom_depth_m"), made["lithology"].alias("lithology"))
    per = intervals.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("i"), F.max("bottom").alias("final"))
    return per.select(F.col("doc").cast("string").alias("document_id"), envelope(F.col("final")).alias("final_depth_m"), F.transform("i", lambda x: x.dropFields("seq")).alias("intervals"))


def interval_rows(records: DataFrame) -> DataFrame:
    """One row per interval with its 0-based place; values without their evidence."""
    rows = records.select("document_id", F.posexplode("intervals").alias("sequence_index", "i"))
    return rows.select("document_id", "sequence_index", *(F.col(f"i.{f}.value").alias(f) for f in ("top_depth_m", "bottom_depth_m", "lithology")))


def provenance_rows(records: DataFrame) -> DataFrame:
    """One row per envelope: document_id, field_path and its evidence."""
    fields = ("top_depth_m", "bottom_depth_m", "lithology")
    inner = F.flatten(F.transform("intervals", lambda x, k: F.array(*(F.struct(F.concat(F.lit("intervals["), k.cast("string"), F.lit(f"].{f}")).alias("field_path"), x[f].alias("e")) for f in fields))))
    own = F.array(F.struct(F.lit("final_depth_m").alias("field_path"), F.col("final_depth_m").alias("e")))
    return records.select("document_id", F.inline(F.concat(own, inner))).select("document_id", "field_path", "e.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of records with the fixed schema; blank lines are skipped."""
    return spark.read.schema(RECORD).json(path)


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, one record a line; an existing folder is an error."""
    records.write.mode("errorifexists").json(path)


def write_tables(records: DataFrame, path: str) -> None:
    """Three zstd Parquet tables: boreholes, intervals and provenance."""
    boreholes = records.select("document_id", F.col("final_depth_m.value").alias("final_depth_m"))
    for name, df in (("boreholes", boreholes), ("intervals", interval_rows(records)), ("provenance", provenance_rows(records))):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")


def geojson(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One feature text per point with both coordinates."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col(key)).alias("properties"))).alias("feature"))


def upsert(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of ``fresh``, and those of ``current`` whose key it doesn't have."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
