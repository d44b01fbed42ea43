"""Shard placement through a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table and
the shards take turns claiming the next free slot of theirs (a shard of weight
w takes w turns a round).  Placing a document is one hash and one lookup;
adding or removing a shard moves few other slots.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import fresh_names

#: The table is broadcast, so its size is bounded: at most 16 MB.
MAX_TABLE = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], size: int = 65_537, weights: list[int] | None = None) -> np.ndarray:
    """Slot -> index into ``names``.

    ``size`` must be a prime no smaller than the number of shards and at most
    ``MAX_TABLE``.  Weights are positive integers.  Order of turns is the order
    of ``names``; equal names would share a permutation and are refused.
    """
    weights = weights or [1] * len(names)
    if not names or len(set(names)) < len(names) or len(weights) != len(names) or min(weights) < 1:
        raise ValueError("shards need distinct names and one positive weight each")
    if not is_prime(size) or not len(names) <= size <= MAX_TABLE:
        raise ValueError(f"the table size must be a prime between {len(names)} and {MAX_TABLE}")
    digest = [hashlib.md5(x.encode()).digest() for x in names]
    offset = [int.from_bytes(d[:8], "little") % size for d in digest]
    skip = [int.from_bytes(d[8:], "little") % (size - 1) + 1 if size > 2 else 1 for d in digest]
    table, at, filled = np.full(size, -1, np.int32), list(offset), 0
    while filled < size:
        for k, turns in enumerate(weights):
            for _ in range(min(turns, size - filled)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % size
                table[at[k]] = k
                filled += 1
    return table


def slot_of(key, size: int):
    """Slot of a key column: 60 bits of the MD5 of its text; null is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int = 64, size: int = 65_537, weights: list[int] | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard_id`` (0-based); no shuffle.

    Rows with equal keys meet in one shard; a null key is placed like the empty
    text.  Columns of those two names in the input are replaced, all others
    stay.  An empty table gives an empty result.
    """
    table = lookup_table([f"shard-{k}" for k in range(shards)], size, weights)
    (at,) = fresh_names(docs, "at")
    slots = docs.sparkSession.createDataFrame(pd.DataFrame({at: np.arange(size, dtype=np.int32), "shard_id": table}))
    placed = docs.withColumn("slot", slot_of(docs[key], size)).drop("shard_id")
    return placed.join(F.broadcast(slots), placed["slot"] == slots[at]).drop(at)
