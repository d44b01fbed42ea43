"""Near-duplicate groups: SuperMinHash, banding, exact verification, union-find.

Documents with equal shingle sets form a class that one of them stands for.
Standing documents that share a band are candidates.  Within a bucket nobody
meets everybody: in each round every member is held against one member of
another component of its bucket, links that hold on the full sets are merged,
and buckets whose members all lie in one component are settled.  What a few
rounds leave open (members that meet in a band by chance) is held against all
members of other components of the bucket, block by block, so no link inside a
bucket is lost and no table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import bounded_batches, fresh_names, materialize, ship_package
from strataframe.llm._text import Texts, mix, slices
from strataframe.llm.components import components
from strataframe.llm.superminhash import band_keys, signatures

#: Two signatures of 256 slots, each cut into bands of 8.  Of links at similarity 0.8 exactly,
#: 1 in 127,000 shares none of the 64 bands; unlike texts (0.1) meet with odds of 1 to 1.5 million.
SIGNATURES, ROWS, SLOTS = 2, 8, 256
#: Rounds in which a bucket's members meet one other member each.
ROUNDS = 2
#: Shingles of the members that a block holds.
BLOCK = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def shingle_sets(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit keys of each document's shingles, and first indices.

    Words are lower-cased (A-Z).  A document of fewer than ``width`` words has
    its whole sequence as one shingle; without words it has none.
    """
    starts, ends, first = texts.split()
    words = texts.hashes(starts, ends, lower=True)
    count = np.diff(first)
    grams = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    past = np.concatenate([[0], np.cumsum(grams)])
    doc = np.repeat(np.arange(texts.n), grams)
    at = np.arange(past[-1]) + np.repeat(first[:-1] - past[:-1], grams)
    last = first[1:][doc]
    keys = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = at + k < last
        keys = np.where(inside, mix(keys * _STEP + words[np.minimum(at + k, max(len(words) - 1, 0))]) if len(words) else keys, keys)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys = keys[new]
    return keys, np.searchsorted(doc[new], np.arange(texts.n + 1))


def _binary_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of 8-byte values as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def set_signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (two longs) of the set, and its band keys."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                keys, first = shingle_sets(texts, width)
                sums = np.zeros((len(keys) + 1, 2), np.uint64)
                for k, salt in enumerate((11, 23)):
                    np.cumsum(mix(keys + np.uint64(salt)), out=sums[1:, k])
                digest = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
                parts = [band_keys(signatures(mix(keys + np.uint64(k)), first, SLOTS), ROWS) for k in range(SIGNATURES)]
                band = np.concatenate([mix(x.view(np.uint64) + np.uint64(k)).view(np.int64) for k, x in enumerate(parts)], axis=1)
                bands = band.shape[1]
                lists = pa.ListArray.from_arrays(np.arange(texts.n + 1, dtype=np.int32) * bands, pa.array(band.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array(np.diff(first)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], _binary_rows(*shingle_sets(texts, width))], ["doc_id", "set"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                if len(x) > len(y):
                    x, y = y, x
                same = 0
                if 100 * len(x) >= percent * len(y):
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    same = int((y[at] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("a")), "u")
    both = left.join(sets.select(F.col("doc_id").alias("v"), F.col("set").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _meetings(members: DataFrame) -> DataFrame:
    """For each member of a bucket a pair with one of another component in it."""
    least = F.min(F.struct("component", "doc", "n"))
    ends = members.groupBy("key").agg(least.alias("lo"), F.max(F.struct("component", F.negate("doc").alias("doc"), "n")).alias("hi"))
    ends = materialize(ends, "bucket-ends")  # a join of two tables: a hot bucket's side can be split
    met = members.join(ends, "key").withColumn("with", F.when(F.col("component") != F.col("lo.component"), F.col("lo")).otherwise(F.struct(F.col("hi.component").alias("component"), F.negate("hi.doc").alias("doc"), F.col("hi.n").alias("n"))))
    return met.select(F.least("doc", "with.doc").alias("u"), F.greatest("doc", "with.doc").alias("v"), "n", F.col("with.n").alias("o_n"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b."""
    size = lambda x: np.array([len(k) for k in x])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def table(flat: np.ndarray, sizes: np.ndarray, part: np.ndarray) -> np.ndarray:
        at = np.searchsorted(part, flat)
        at[at == len(part)] = 0
        hit = part[at] == flat
        dense = np.zeros((len(sizes), len(part)), np.float32)
        dense[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
        return dense

    for k in range(0, len(both), 4096):
        part = both[k : k + 4096]
        out += table(flat_a, size(a), part) @ table(flat_b, size(b), part).T
    return out


def _remaining(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that lie in different components.

    The largest component of a bucket needs no comparison with itself: its
    members and the others are dealt into blocks by a hash, and each block of
    others is held against every block.
    """
    sums = members.groupBy("key", "component").agg(F.sum("n").alias("n"))
    main = sums.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("all_n")).withColumnRenamed("key", "m_key")
    main = materialize(main, "main-components")
    sided = members.join(main, F.col("key") == F.col("m_key")).withColumn("other", F.col("component") != F.col("main"))
    blocks = F.ceil(F.when(F.col("other"), F.col("all_n") - F.col("main_n")).otherwise(F.col("main_n")) / BLOCK)
    placed = sided.withColumn("block", F.pmod(F.xxhash64("doc"), blocks)).select("key", "other", "block", "doc", "component")
    full = placed.join(sets.withColumnRenamed("doc_id", "s_id"), F.col("doc") == F.col("s_id"))
    packed = full.groupBy("key", "other", "block").agg(F.collect_list(F.struct("doc", "component", "set")).alias("of"))
    packed = materialize(packed, "blocks")
    left = packed.where("other").select("key", F.col("block").alias("l_block"), F.col("of").alias("l_of"))
    pairs = left.join(packed, "key").where(~F.col("other") | (F.col("l_block") <= F.col("block"))).select("l_of", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for column in batch.columns:
                    rows = column[k].values
                    sides.append((rows.field("doc").to_numpy(), rows.field("component").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("set")]))
                (a, a_in, a_sets), (b, b_in, b_sets) = sides
                same = _common(a_sets, b_sets)
                union = np.array([len(x) for x in a_sets])[:, None] + np.array([len(x) for x in b_sets])[None, :] - same
                x, y = np.nonzero((100 * same >= percent * union) & (a_in[:, None] != b_in[None, :]))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(a[x]), pa.array(b[y])], ["u", "v"])

    return pairs.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept.

    Documents are linked if ``100 * shared >= percent * union`` of their
    distinct ``width``-word shingles.  ``component_id`` is the least doc_id
    reachable over links, ``kept`` marks it.  Null and empty texts have no
    shingles and are linked with nothing; a null doc_id has a null component
    and is kept; repeated rows belong together.  Other columns are ignored; an
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(set_signatures(docs, width), "signatures")
    real = signed.where("doc_id is not null and n_shingles > 0")
    stands = materialize(real.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("doc")), "classes")
    heads = real.join(stands.select("doc"), F.col("doc_id") == F.col("doc"), "left_semi").dropDuplicates(["doc_id"])
    entries = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    shared = entries.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = materialize(shared, "shared-keys")
    members = materialize(entries.join(shared, "key", "left_semi"), "buckets")
    candidates = members.select("doc").distinct()
    sets = materialize(_sets(docs.join(candidates, F.col("doc_id") == F.col("doc"), "left_semi"), width).dropDuplicates(["doc_id"]), "sets")

    links, tested, labels = None, None, None
    for turn in range(ROUNDS + 1):
        now = members.withColumn("component", F.col("doc"))
        if labels is not None:
            now = members.join(labels, members["doc"] == labels["node"], "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("component"))
        if turn:  # a bucket of two was held against itself in the first round
            split = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("c")).where("a < b and c > 2").select("key")
            now = materialize(now.join(split, "key", "left_semi"), "open-buckets")
        if turn == ROUNDS:
            found = _remaining(now, sets, percent)
        else:
            met = _meetings(now).where(f"u < v and 100 * least(n, o_n) >= {percent} * greatest(n, o_n)").select("u", "v").distinct()
            if tested is not None:
                met = met.join(tested, ["u", "v"], "left_anti")
            met = materialize(met, "meetings")
            tested = met if tested is None else tested.unionByName(met)
            found = _verified(met, sets, percent)
        found = materialize(found, "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = materialize(components(links), "components")
    of_class = real.join(stands, ["d1", "d2", "n_shingles"]).select("doc_id", "doc").distinct()
    if labels is not None:
        of_class = of_class.join(labels, of_class["doc"] == labels["node"], "left").select("doc_id", F.coalesce("component", "doc").alias("doc"))
    named = of_class.select(F.col("doc_id").alias("m_id"), F.col("doc").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(named, F.col("doc_id") == F.col("m_id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the least doc_id.

    Rows that repeat a doc_id are one document and stay together; rows with a
    null doc_id stay.
    """
    (copy,) = fresh_names(docs, "copy")
    copies = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(copies, docs["doc_id"].cast("long") == copies[copy], "left_anti")
