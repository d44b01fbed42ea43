"""Files: interval tables, predictions, features with coordinates, run folders, hashes."""

from __future__ import annotations

import json
import re
import struct
from datetime import date
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an interval table, and what a run's metadata must tell.
INTERVAL_COLUMNS = ("interval_id", "top_depth_m", "bottom_depth_m", "thickness_m", "stratum_code_raw", "stratum_code_normalized", "lithology_raw", "lithology_normalized", "description_raw", "description_normalized")
RUN_KEYS = ("experiment_id", "git_commit", "date", "dataset_version", "split_version", "model", "model_revision", "prompt_version", "seed", "hardware", "software", "config")


def read_interval_table(spark: SparkSession, path: str, encoding: str = "cp1252") -> DataFrame:
    """A CSV of texts with a header, as it is; numbers are for :func:`~strataframe.operators.manifests.gold_intervals` to judge.

    Spark's own reader takes UTF-8 and ISO-8859-1 alike encodings.  Of Windows
    encodings the letters are the same; their quotes and dashes, which
    ISO-8859-1 leaves as control characters, are put right afterwards.
    """
    windows = encoding.lower() in ("cp1252", "windows-1252")
    rows = spark.read.option("header", True).option("encoding", "iso-8859-1" if windows else encoding).option("multiLine", True).option("escape", '"').csv(path)
    if not windows:
        return rows
    known = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    pairs = [(a, b) for a, b in known.items() if b]
    return rows.select(*(F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)).alias(c) for c in rows.columns))


def write_interval_table(intervals: DataFrame, path: str) -> None:
    """CSV with the ten columns of an interval table, missing ones empty; an existing folder is an error."""
    columns = [(F.col(c) if c in intervals.columns else F.lit(None)).cast("string").alias(c) for c in INTERVAL_COLUMNS]
    intervals.select(*columns).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def read_predictions(spark: SparkSession, path: str, schema: str, key: str = "item_id") -> DataFrame:
    """JSON lines with a key each; blank lines are skipped, a missing or repeated key is an error."""
    rows = spark.read.schema(schema).json(path)
    bad = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).limit(3).collect()
    if bad:
        raise ValueError(f"missing or repeated {key}: {[r[key] for r in bad]}")
    return rows


def feature_collection(points: DataFrame, key: str, x: str, y: str, system: str) -> tuple[DataFrame, list[str]]:
    """Feature texts of points with both coordinates, and the sorted coordinate systems they are in (nothing is reprojected)."""
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    systems = [r[0] for r in known.where(F.col(system).isNotNull()).select(F.col(system).cast("string")).distinct().orderBy(system).collect()]  # few by nature
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    return known.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col(key), F.col(system).alias("coordinate_system")).alias("properties"))).alias("feature")), systems


def write_feature_collection(points: DataFrame, path: str, key: str, x: str, y: str, system: str) -> None:
    """A folder of feature lines and ``collection.json``, which names the systems and holds the features' number."""
    features, systems = feature_collection(points, key, x, y, system)
    features.write.mode("errorifexists").text(f"{path}/features")
    head = json.dumps({"type": "FeatureCollection", "coordinate_systems": systems, "feature_lines": "features"}, sort_keys=True)
    points.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/collection")


def write_geoparquet(points: DataFrame, path: str, x: str, y: str, system: str) -> None:
    """Parquet with a WKB ``geometry`` column of points, all in the one EPSG system that the table must have.

    Every part carries the metadata that readers of geometries look for.
    Tasks write their own files, so the points are never gathered.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    found = known.agg(F.collect_set(F.col(system).cast("string")).alias("s"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1")).first()
    if len(found["s"]) != 1 or not found["s"][0].upper().startswith("EPSG:"):
        raise ValueError(f"one EPSG system is needed, found {sorted(found['s'])}")

    @F.pandas_udf("binary")
    def wkb(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<BIdd", 1, 1, p, q) for p, q in zip(a, b, strict=True)])

    known.withColumn("geometry", wkb(F.col(x).cast("double"), F.col(y).cast("double"))).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/data")
    meta = {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Point"], "crs": found["s"][0].upper(), "bbox": [found[c] for c in ("x0", "y0", "x1", "y1")]}}}
    points.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/geo")


def create_run(spark: SparkSession, root: str, metadata: dict) -> str:
    """A new folder, by date and name, with a run's metadata; a run that exists, lacks a key or is named oddly is refused."""
    if missing := [k for k in RUN_KEYS if k not in metadata]:
        raise ValueError(f"the run's metadata lack {missing}")
    day, name = date.fromisoformat(str(metadata["date"])), str(metadata["experiment_id"])
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("a run's name has letters, digits, underscores and hyphens only")
    path = f"{root.rstrip('/')}/{day.isoformat()}/{name}"
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/run")
    return path


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), size and SHA-256 of every file of a folder, wherever Spark can read it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = Path(path.split("://")[-1]).as_posix().rstrip("/")
    return files.select(F.regexp_replace("path", "^.*" + base.replace(".", r"\.") + "/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def surface_grid(xs: list[float], ys: list[float]) -> tuple[list[tuple[int, float, float]], list[tuple[int, int, int]]]:
    """Places of a regular grid, row by row, and its triangles (two a cell) by their places' numbers."""
    if len(xs) < 2 or len(ys) < 2 or any(b <= a for v in (xs, ys) for a, b in zip(v, v[1:], strict=False)):
        raise ValueError("both axes must increase and have two values at least")
    places = [(j * len(xs) + i, x, y) for j, y in enumerate(ys) for i, x in enumerate(xs)]
    corners = [j * len(xs) + i for j in range(len(ys) - 1) for i in range(len(xs) - 1)]
    return places, [t for c in corners for t in ((c, c + 1, c + len(xs)), (c + 1, c + len(xs) + 1, c + len(xs)))]


def read_word_table(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's TSV: page, line (of its block and paragraph), box, text and confidence; rows without a word are left out."""
    t = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    n = lambda c: F.col(c).try_cast("double")
    words = t.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return words.select(
        n("page_num").cast("int").alias("page"), F.concat_ws("/", "block_num", "par_num", "line_num").alias("line"), n("left").alias("x0"), n("top").alias("y0"), (n("left") + n("width")).alias("x1"), (n("top") + n("height")).alias("y1"), "text", n("conf").alias("confidence"),
    )
