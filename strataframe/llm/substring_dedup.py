"""Removal of repeated byte strings: minimizers, then suffix arrays of shards.

Every ``width``-byte window is named by its least ``gram``-byte string, so two
equal windows have equal names and lie equally around them.  Windows next to
each other with one name make a piece.  Names that occur once can't be in a
repeat; pieces of which another copy exists are repeated as a whole.  What is
left, different pieces with a name in common, is gathered by name into shards
whose suffix arrays (induced sorting) and permuted common prefixes show which
windows occur elsewhere.  A name with very many different pieces is first cut:
the range of its windows is halved and regrouped by the bytes that all windows
of a half share, until groups are small.  Equal texts are one text throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import bounded_batches, fresh_names, materialize, release, ship_package
from strataframe.llm._text import Texts, mix, slices, string_buffers
from strataframe.llm.suffix_array import permuted_prefixes, suffix_array

WIDTH = 200
#: Bytes of a name.
GRAM = 40
#: Different pieces of one name that a shard takes; more are cut first.
GROUP = 2000
#: Bytes of pieces in one suffix array.
SHARD_BYTES = 1 << 20
_POSITION_BITS = 24
#: Windows that are named at once.
_RUN = 1 << 22
#: Between pieces; never a byte of UTF-8.
_GAP = b"\xff"


def named_pieces(texts: Texts, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Pieces of all texts: text number, first window (in the text), windows, name's distance, name."""
    found = [_pieces(texts, a, min(a + _RUN, len(texts.data) - width + 1), width, gram) for a in range(0, max(0, len(texts.data) - width + 1), _RUN)]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pieces(texts: Texts, lo: int, hi: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Pieces of the windows that start at lo..hi-1 of the slice."""
    part = Texts(texts.data[lo : hi + width - 1], np.array([0, hi + width - 1 - lo]))
    sums, inverse = part.prefix(False)
    n = len(part.data) - gram + 1
    name = mix((sums[gram:] - sums[:-gram]) * inverse[:n])
    span = width - gram + 1
    key = (name & ~np.uint64((1 << _POSITION_BITS) - 1)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.uint64(2**64 - 1))
    padded[:n] = key
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = hi - lo
    least = np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows])
    at = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    start = np.arange(lo, hi)
    doc = np.searchsorted(texts.offsets, start, "right") - 1
    # Of empty documents at one offset the last is found, which is the one with the bytes.
    inside = start + width <= texts.offsets[doc + 1]
    begin = inside.copy()
    begin[1:] &= ~(inside[:-1] & (at[1:] == at[:-1]) & (doc[1:] == doc[:-1]))
    first = np.flatnonzero(begin)
    group = np.cumsum(begin) - 1
    count = np.bincount(group[inside], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    return doc[first], start[first] - texts.offsets[doc[first]], count, at[first] - first, name[at[first]].view(np.int64)


def _content(texts: Texts, doc: np.ndarray, first: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    sums, inverse = texts.prefix(False)
    a = texts.offsets[doc] + first
    return mix((sums[a + count + width - 1] - sums[a]) * inverse[a] + count.astype(np.uint64)).view(np.int64)


def _binary_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    past = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(past[-1]) + np.repeat(starts - past[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(past.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[source]))]).cast(pa.binary())


def _key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _names(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """doc_id, key, n_bytes and the names of each text's pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column(2)):
                doc, _, _, _, name = named_pieces(texts, width, gram)
                first = np.searchsorted(doc, np.arange(texts.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], batch.column(1)[at:to], pa.array(np.diff(texts.offsets)), pa.ListArray.from_arrays(pa.array(first), pa.array(name))], ["doc_id", "key", "n_bytes", "names"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id bigint, key string, n_bytes bigint, names array<bigint>")


def _candidates(texts_with: DataFrame, width: int, gram: int) -> DataFrame:
    """Pieces whose number is listed in ``wanted``: name, content, text, first, windows, distance, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, to, texts in slices(batch.column(1)):
                doc, first, count, distance, name = named_pieces(texts, width, gram)
                begin = np.searchsorted(doc, np.arange(texts.n + 1))
                wanted = [np.asarray(batch.column(2)[k].values.to_numpy(zero_copy_only=False), np.int64) + begin[k - at] for k in range(at, to)]
                take = np.sort(np.concatenate(wanted))
                for part in np.array_split(take, max(1, len(take) // 20_000)):
                    d, f, c = doc[part], first[part], count[part]
                    a = texts.offsets[d] + f
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name[part]), pa.array(_content(texts, d, f, c, width)), pa.array(ids[at + d]), pa.array(f), pa.array(c), pa.array(distance[part]), _binary_slices(texts.data, a, a + c + width - 1)],
                        ["name", "content", "cid", "first", "windows", "distance", "bytes"],
                    )

    return texts_with.select("cid", "text", "wanted").mapInArrow(run, "name bigint, content bigint, cid bigint, first bigint, windows bigint, distance bigint, bytes binary")


def _shard_repeats(pieces: DataFrame, width: int) -> DataFrame:
    """cid and window ranges [first, past) of windows that occur in another piece of their group.

    ``pieces`` has group, cid, first, windows, bytes; different groups have no
    window in common, so a shard may hold several.
    """

    def repeats(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(_GAP.join(r[3] for r in rows), np.uint8)
        size = np.array([len(r[3]) for r in rows])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        phi, prefix = permuted_prefixes(data, suffix_array(data), 4 * width)
        again = prefix >= width
        again[phi[again]] = True
        piece = np.searchsorted(begin, np.arange(len(data)), "right") - 1
        windows = np.array([r[2] for r in rows])
        again &= np.arange(len(data)) - begin[piece] < windows[piece]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        p = piece[a]
        cid, first = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cid[p]), pa.array(first[p] + a - begin[p]), pa.array(first[p] + b - begin[p])], ["cid", "first", "past"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        held, last = 0, None
        for batch in batches:
            for group, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= SHARD_BYTES and group != last:
                    yield repeats(rows)
                    rows, held = [], 0
                rows.append(tuple(row))
                held, last = held + len(row[3]) + 1, group
        if rows:
            yield repeats(rows)

    spark = pieces.sparkSession
    dealt = pieces.select("group", "cid", "first", "windows", "bytes").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "cid", "first")
    return dealt.mapInArrow(run, "cid bigint, first bigint, past bigint")


def _cut(pieces: DataFrame, width: int, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Cut pieces of large groups; small-grouped pieces, and ranges found repeated on the way.

    A piece has ``distance`` from its first window to its name.  The windows of
    a group that lie equally around the name are the same range of distances;
    ranges are halved, and each half is grouped by what its windows share.
    """
    spark = pieces.sparkSession
    now = pieces.select("group", "cid", "first", "windows", F.col("distance").alias("hi"), "bytes").withColumn("lo", F.col("hi") - F.col("windows") + 1)
    small, repeated = [], []
    span = WIDTH
    now = now.withColumns({"from": F.lit(0).cast("long"), "past": F.lit(width).cast("long")})
    while True:
        sizes = materialize(now.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "group-sizes")
        large = sizes.where(F.col("n") > limit).select(F.col("group").alias("g"))
        fine = sizes.where((F.col("n") > 1) & (F.col("n") <= limit)).select(F.col("group").alias("g"))
        small.append(now.join(fine, F.col("group") == F.col("g"), "left_semi"))
        rest = materialize(now.join(large, F.col("group") == F.col("g"), "left_semi"), "large-groups")
        if rest.isEmpty() or span <= 1:
            if not rest.isEmpty():  # single windows: their group is their content
                repeated.append(rest.select("cid", "first", (F.col("first") + 1).alias("past")))
            break
        span = -(-span // 2)
        middle = F.expr(f"`from` + {span}")
        halves = rest.withColumn("half", F.explode(F.array(F.struct(F.col("from").alias("a"), F.least(middle, F.col("past")).alias("b")), F.struct(F.least(middle, F.col("past")).alias("a"), F.col("past").alias("b")))))
        # Distances a..b-1 that the piece really has: lo..hi.
        a, b = F.greatest("half.a", "lo"), F.least(F.col("half.b") - 1, F.col("hi"))
        cut = halves.withColumns({"a": a, "b": b}).where("a <= b")
        # A window of distance d starts at first + hi - d.
        moved = cut.select(
            "group", "cid", (F.col("first") + F.col("hi") - F.col("b")).alias("first"), (F.col("b") - F.col("a") + 1).alias("windows"), F.col("half.a").alias("from"), F.col("half.b").alias("past"),
            F.substring("bytes", (F.col("hi") - F.col("b") + 1).cast("int"), (F.col("b") - F.col("a") + width).cast("int")).alias("bytes"), F.col("a").alias("lo"), F.col("b").alias("hi"),
        )
        # Shared by every window whose distance lies in the half: from distance ``from`` back to what the farthest one ends with.
        shared = F.substring("bytes", (F.col("hi") - F.col("from") + 1).cast("int"), (F.lit(width) - (F.col("past") - 1 - F.col("from"))).cast("int"))
        now = moved.withColumn("group", F.xxhash64("group", "from", shared))
        now = materialize(now, "cut-pieces")
        content = now.groupBy("group", "lo", "hi", F.xxhash64("bytes").alias("c"), F.sha2("bytes", 256).alias("s")).agg(F.count("*").alias("n"))
        copies = content.where("n > 1").select(F.col("group").alias("g"), F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("s"))
        marked = now.withColumn("own", F.sha2("bytes", 256)).join(copies, (F.col("group") == F.col("g")) & (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")) & (F.col("own") == F.col("s")), "left")
        marked = materialize(marked.select("group", "cid", "first", "windows", "from", "past", "bytes", "lo", "hi", F.col("s").isNotNull().alias("copied"), "own"), "marked-pieces")
        repeated.append(marked.where("copied").select("cid", "first", (F.col("first") + F.col("windows")).alias("past")))
        # One of equal pieces still shows the others what they share with it.
        alone = marked.where("not copied")
        one = marked.where("copied").dropDuplicates(["group", "lo", "hi", "own"])
        now = alone.unionByName(one).drop("copied", "own")
    out = small[0]
    for x in small[1:]:
        out = out.unionByName(x.select(out.columns))
    return out, repeated


def _merged(ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Byte spans that windows first..past-1 cover, those that touch as one."""
    out: list[list[int]] = []
    for first, past in sorted(ranges):
        end = past - 1 + width
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def _removed(texts: DataFrame, width: int) -> DataFrame:
    """cid, removed spans and the digest of what is kept; ``texts`` has cid, text, ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            spans, digests = [], []
            for k, ranges in enumerate(batch.column(2).to_pylist()):
                whole = data[offsets[k] : offsets[k + 1]].tobytes()
                cut = _merged([(r["first"], r["past"]) for r in ranges], width)
                keep, at = hashlib.sha256(), 0
                for a, b in cut:
                    keep.update(whole[at:a])
                    at = b
                keep.update(whole[at:])
                spans.append([{"start": a, "past": b} for a, b in cut])
                digests.append(keep.hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(digests)], ["cid", "removed", "kept_sha256"])

    return texts.select("cid", "text", "ranges").mapInArrow(run, "cid bigint, removed array<struct<start: bigint, past: bigint>>, kept_sha256 string")


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_bytes, removed byte spans and kept_sha256.

    A byte is removed if a ``width``-byte string of one document that also
    starts anywhere else, in the same document or another, covers it; strings
    never cross documents.  Null texts are empty; texts under ``width`` bytes
    lose nothing; repeated rows are copies of each other; null ids are kept as
    such; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark, 256)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), "text")
    named = materialize(_names(keyed, width, gram), "piece-names")
    grouped = named.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"), F.first("names").alias("names"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "texts")
    entries = classes.select("cid", F.posexplode("names").alias("number", "name"))
    shared = entries.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("s_name"))
    shared = materialize(shared, "shared-names")  # a join of two tables: a hot name's side can be split
    wanted = entries.join(shared, F.col("name") == F.col("s_name"), "left_semi").groupBy("cid").agg(F.collect_list("number").alias("wanted"))
    wanted = wanted.withColumnRenamed("cid", "w_cid")
    asked = classes.join(wanted, F.col("cid") == F.col("w_cid")).select("cid", F.col("key").alias("c_key"), "doc", "wanted")
    texts = materialize(keyed.join(asked, (F.col("key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("doc"))).select("cid", "text", "wanted"), "shared-texts")

    pieces = materialize(_candidates(texts, width, gram), "pieces")
    same = ["name", "content", "windows", "distance"]
    contents = materialize(pieces.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("cid", "first")).alias("at")), "contents")
    copied = pieces.join(contents.where("n > 1").select(*same), same, "left_semi").select("cid", "first", (F.col("first") + F.col("windows")).alias("past"))
    copied = materialize(copied, "copied")
    several = contents.groupBy("name").agg(F.count("*").alias("d")).where("d > 1").select(F.col("name").alias("s_name"))
    several = materialize(several, "names-of-several")
    heads = contents.join(several, F.col("name") == F.col("s_name"), "left_semi").select(F.col("at.cid").alias("h_cid"), F.col("at.first").alias("h_first"))
    apart = pieces.join(heads, (F.col("cid") == F.col("h_cid")) & (F.col("first") == F.col("h_first")), "left_semi").withColumnRenamed("name", "group")
    apart = materialize(apart, "apart")
    release(shared, pieces, contents, several)  # what follows reads their pieces from the written ones
    small, ranges = _cut(apart, width, group)
    ranges = [copied, _shard_repeats(small, width), *ranges]
    found = ranges[0]
    for x in ranges[1:]:
        found = found.unionByName(x)
    per_text = found.groupBy("cid").agg(F.collect_set(F.struct("first", "past")).alias("ranges")).withColumnRenamed("cid", "r_cid")
    touched = _removed(texts.join(per_text, F.col("cid") == F.col("r_cid")), width).dropDuplicates(["cid"]).withColumnRenamed("cid", "t_cid")
    verdict = classes.join(touched, F.col("cid") == F.col("t_cid"), "left").select(F.col("key").alias("v_key"), "copies", "removed", "kept_sha256")
    out = named.select("doc_id", "key", "n_bytes").join(verdict, F.col("key") == F.col("v_key"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("past")))
    none = F.array().cast("array<struct<start: bigint, past: bigint>>")
    return out.select(
        "doc_id", "n_bytes", F.when(whole, all_of_it).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "key")).alias("kept_sha256"), "key",
    )


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text``; bytes that no longer make a character are dropped."""
    own, key, cut = fresh_names(docs, "own", "key", "cut")
    found = repeats(docs.select("doc_id", "text"), width).dropDuplicates(["key"]).select(F.col("key").alias(key), F.col("removed").alias(cut))
    joined = docs.withColumn(own, _key(docs["text"])).join(found, F.col(own) == F.col(key))  # equal texts lose the same bytes
    raw = F.col("text").cast("binary")
    left = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["past"]))
    right = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.octet_length("text").cast("long")))
    kept = F.transform(F.arrays_zip(left.alias("a"), right.alias("b")), lambda p: F.hex(F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    text = F.when(F.size(cut) == 0, F.col("text")).otherwise(F.decode(F.unhex(F.array_join(kept, "")), "UTF-8"))
    return joined.withColumn("text", text).select(*docs.columns)


def span_bytes() -> Column:
    return F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["past"] - r["start"])
