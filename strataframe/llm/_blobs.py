"""Rows of 64-bit columns sent through a shuffle as packed arrays.

A shuffle of single rows costs the JVM a few hundred nanoseconds and tens of
bytes a row.  Packed, a task sends each shard one array per buffer, and the
shard's task reads it back without touching rows.  A row's number is kept only
where it is not 1.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strataframe.llm._text import HashIndex

#: Bytes that a task gathers before it sends them.
BUFFER_BYTES = 40 << 20
SCHEMA = "shard int, kind int, blob binary"


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_of(keys: np.ndarray, count: int) -> np.ndarray:
    """Shards of well-mixed keys."""
    return (keys >> np.uint64(33)) % np.uint64(count)


def pack(shard: np.ndarray, columns: list[np.ndarray], n: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """A blob per shard: numbers of rows and of those met several times, the columns, and the latter's counts."""
    by = shard.astype(np.int64) * 2 + (n == 1)
    order = np.argsort(by.astype(np.uint16) if len(by) and by.max() < 65536 else by, kind="stable")
    by, columns, n = by[order], [c[order].view(np.uint64) for c in columns], n[order].astype(np.uint32)
    told = np.unique(by >> 1)
    start, single, end = (np.searchsorted(by, 2 * told + k) for k in range(3))
    blobs = [
        b"".join([np.array([e - a, m - a], np.uint64).tobytes(), *(c[a:e].tobytes() for c in columns), n[a:m].tobytes()])
        for a, m, e in zip(start.tolist(), single.tolist(), end.tolist(), strict=True)
    ]
    return pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(np.full(len(told), kind, np.int32)), pa.array(blobs, pa.binary())], ["shard", "kind", "blob"])


def unpack(blobs: list, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns and numbers of the rows of all blobs."""
    parts, counts = [], []
    for blob in blobs:
        rows, several = np.frombuffer(blob, np.uint64, 2).tolist()
        parts.append(np.frombuffer(blob, np.uint64, rows * width, 16).reshape(width, rows))
        n = np.ones(rows, np.int64)
        n[:several] = np.frombuffer(blob, np.uint32, several, 16 + 8 * rows * width)
        counts.append(n)
    if not parts:
        return [np.zeros(0, np.uint64)] * width, np.zeros(0, np.int64)
    return [np.concatenate([p[k] for p in parts]) for k in range(width)], np.concatenate(counts)


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of whole numbers, all first bytes, then all second ones ..., so that even ones shrink in a shuffle."""
    values = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    return b"".join(values[:, k].tobytes() for k in range(width))


def from_planes(data, size: int, width: int, start: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, size * width, start).reshape(width, size).T
    return out.reshape(-1).view(np.uint64)


def pack_codes(shard: np.ndarray, codes: np.ndarray, n: np.ndarray, width: int, kind: int) -> pa.RecordBatch:
    """A blob per shard of codes of ``width`` bytes: numbers of codes and of those met several times, the codes, and the latter's counts."""
    by = shard.astype(np.int64) * 2 + (n == 1)
    order = np.argsort(by.astype(np.uint16) if len(by) and by.max() < 65536 else by, kind="stable")
    by, codes, n = by[order], codes[order], n[order]
    told = np.unique(by >> 1)
    start, single, end = (np.searchsorted(by, 2 * told + k).tolist() for k in range(3))
    blobs = [b"".join([np.array([e - a, m - a], np.int64).tobytes(), planes(codes[a:e], width), planes(n[a:m], 4)]) for a, m, e in zip(start, single, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(np.full(len(told), kind, np.int32)), pa.array(blobs, pa.binary())], ["shard", "kind", "blob"])


def unpack_codes(blobs: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all blobs."""
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blob in blobs:
        size, several = np.frombuffer(blob, np.int64, 2).tolist()
        codes.append(from_planes(blob, size, width, 16))
        n = np.ones(size, np.int64)
        n[:several] = from_planes(blob, several, 4, 16 + size * width)
        counts.append(n)
    return np.concatenate(codes), np.concatenate(counts)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of all places of runs, one run after another."""
    past = np.cumsum(lengths)
    return np.arange(past[-1] if len(past) else 0) + np.repeat(starts - past + lengths, lengths)


def pack_runs(shard: np.ndarray, lengths: np.ndarray, lead: np.ndarray, n: np.ndarray, starts: np.ndarray, tokens: np.ndarray, kind: int = 0, known: HashIndex | None = None) -> pa.RecordBatch:
    """A blob per shard of runs of ``tokens``: numbers of runs and tokens, the runs' lengths, leads and numbers of times, and their tokens.

    Tokens among the ``known`` ones, under 2**24, go as three bytes of their position, others as that past the last and as they are.
    """
    order = np.argsort(shard, kind="stable")
    shard, lengths, lead, n, starts = (x[order] for x in (shard, lengths, lead, n, starts))
    told = np.unique(shard)
    start, end = np.searchsorted(shard, told), np.searchsorted(shard, told, "right")
    blobs = []
    for a, e in zip(start.tolist(), end.tolist(), strict=True):
        body = tokens[spread(starts[a:e], lengths[a:e])]
        sent = [body.tobytes()]
        if known is not None:
            at = known.find(body)
            sent = [planes(np.where(at < 0, known.size, at), 3), body[at < 0].tobytes()]
        blobs.append(b"".join([np.array([e - a, len(body)], np.int64).tobytes(), *(x[a:e].astype(np.uint32).tobytes() for x in (lengths, lead, n)), *sent]))
    return pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(np.full(len(told), kind, np.int32)), pa.array(blobs, pa.binary())], ["shard", "kind", "blob"])


def unpack_runs(blobs: list, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, leads, numbers of times and tokens of the runs of all blobs; ``known`` are the tokens sent as positions."""
    heads, tokens = [np.zeros((3, 0), np.uint32)], [np.zeros(0, np.uint64)]
    for blob in blobs:
        runs, size = np.frombuffer(blob, np.int64, 2).tolist()
        heads.append(np.frombuffer(blob, np.uint32, 3 * runs, 16).reshape(3, runs))
        if known is None:
            tokens.append(np.frombuffer(np.frombuffer(blob, np.uint8, 8 * size, 16 + 12 * runs), np.uint64))
            continue
        at = from_planes(blob, size, 3, 16 + 12 * runs).astype(np.int64)
        other = at == len(known)
        words = np.append(known, np.uint64(0))[at]
        words[other] = np.frombuffer(np.frombuffer(blob, np.uint8, 8 * int(other.sum()), 16 + 12 * runs + 3 * size), np.uint64)
        tokens.append(words)
    return *np.concatenate(heads, axis=1).astype(np.int64), np.concatenate(tokens)


def pack_asked(shard: np.ndarray, keys: np.ndarray, rows: np.ndarray, first: int, kind: int, width: int = 8) -> pa.RecordBatch:
    """A blob per shard of keys of ``width`` bytes and the rows that ask for them, which are ``first`` and those under 65536 after it; in each blob by rows, told by their steps."""
    near = rows - first
    if len(near) and near.max() >= 65536:
        raise ValueError("too many rows at once")
    order = np.argsort(shard.astype(np.int64) << 16 | near)
    shard, keys, near = shard[order], keys[order], near[order]
    told = np.unique(shard)
    start, end = np.searchsorted(shard, told).tolist(), np.searchsorted(shard, told, "right").tolist()
    blobs = [b"".join([np.array([e - a, first], np.int64).tobytes(), keys[a:e].tobytes() if width == 8 else planes(keys[a:e], width), planes(np.diff(near[a:e], prepend=0), 2)]) for a, e in zip(start, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(told.astype(np.int32)), pa.array(np.full(len(told), kind, np.int32)), pa.array(blobs, pa.binary())], ["shard", "kind", "blob"])


def unpack_asked(blobs: list, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of all blobs."""
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for blob in blobs:
        size, first = np.frombuffer(blob, np.int64, 2).tolist()
        keys.append(np.frombuffer(blob, np.uint64, size, 16) if width == 8 else from_planes(blob, size, width, 16))
        rows.append(np.cumsum(from_planes(blob, size, 2, 16 + width * size)) + np.uint64(first))
    return np.concatenate(keys), np.concatenate(rows)


def gather(batches: Iterable[pa.RecordBatch]) -> dict[int, list]:
    """All blobs of a task by kind."""
    out: dict[int, list] = {}
    for batch in batches:
        for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            out.setdefault(kind, []).append(blob.as_buffer())
    return out


def deal(df: DataFrame, count: int | None = None) -> DataFrame:
    """Each shard's blobs to the task of its number."""
    return df.repartitionById(count or shards(df.sparkSession), "shard")
