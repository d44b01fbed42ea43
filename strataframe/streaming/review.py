"""Review sessions and event-time windows, over batches and streams alike."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.operators._workers import ship_package


def sessions(events: DataFrame, key: str, start: str, complete: str) -> DataFrame:
    """Per key and completion: the start directly before it and the seconds between.

    A completion without a start directly before it has status ``unknown``.
    """
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    relevant = events.where(F.col("event_type").isin(start, complete)).withColumns({"was": F.lag("event_type").over(order), "since": F.lag("ts").over(order)})
    done = relevant.where(F.col("event_type") == complete)
    known = F.col("was") == start
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    return done.select(key, "event_id", F.when(known, F.round(seconds / 1e6, 3)).alias("seconds"), F.when(known, "completed").otherwise("unknown").alias("status"))


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events of Parquet files as they arrive in a folder, with an event-time column."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per window and type; later ones than ``late`` are left out of a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_stream(events: DataFrame, key: str, start: str, complete: str, late: str = "1 hour", expire_days: int = 30) -> DataFrame:
    """The sessions of a stream, the same as :func:`sessions` tells of the events that weren't too late.

    Events wait until the watermark (the latest time seen less ``late``) has
    passed them and are then taken in order of time, so it makes no difference
    in which micro-batch they came; later ones than that are left out.  A start
    is remembered for ``expire_days`` and forgotten then; a key without waiting
    events and without a start has no state.
    """
    kind = events.schema[key].dataType.simpleString()
    expire = expire_days * 86_400_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, since = json.loads(state.get[0]) if state.exists else ([], None)
        new = [] if state.hasTimedOut else [pd.DataFrame({"at": f["ts"].astype("datetime64[us]").astype("int64"), "id": f["event_id"], "kind": f["event_type"]}) for f in frames]
        rows = pd.concat([pd.DataFrame(waiting, columns=["at", "id", "kind"]), *new], ignore_index=True).astype({"at": "int64", "id": "int64"}).sort_values(["at", "id"], kind="stable")
        mark = state.getCurrentWatermarkMs() * 1000
        ready, rest = rows[rows["at"] <= mark], rows[rows["at"] > mark]
        # The event before each, that of the first one being the start that is remembered.
        kinds, at = ready["kind"].tolist(), ready["at"].tolist()
        table = pd.DataFrame({"id": ready["id"].tolist(), "kind": kinds, "was": ([None if since is None else start, *kinds])[: len(kinds)], "at": at, "since": ([since or 0, *at])[: len(at)]})
        done = table[table["kind"] == complete]
        known = done["was"] == start
        seconds = ((done["at"] - done["since"]) / 1e6).round(3).where(known)
        if kinds:
            since = at[-1] if kinds[-1] == start else None
        if since is not None and since < mark - expire:
            since = None
        if len(rest) or since is not None:
            state.update((json.dumps([rest[["at", "id", "kind"]].values.tolist(), since]),))
            wake = int(rest["at"].iloc[0]) if len(rest) else since + expire
            state.setTimeoutTimestamp(max(wake // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(done), "event_id": done["id"].astype("int64"), "seconds": seconds.astype("float64"), "status": known.map({True: "completed", False: "unknown"}).astype("object")})

    ship_package(events.sparkSession)
    relevant = events.withWatermark("ts", late).where(F.col("event_type").isin(start, complete))
    return relevant.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, seconds double, status string", "kept string", "append", "EventTimeTimeout")
