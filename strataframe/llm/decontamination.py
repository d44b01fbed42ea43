"""Benchmark decontamination: BM25 inverted index with block-max WAND, then overlap.

Test items are indexed by posting lists of BM25 impacts.  Items are numbered by
their threshold, the least first, and cut into blocks; each list knows its
greatest impact and that of each block.  Every window of a training text is a
query.  Block-max WAND moves the cursors of a window's lists: the pivot is the
first item that the lists up to it could bring to its threshold, its block is
opened only if the block's maxima could too, and items are scored in full only
where all cursors before the pivot have met.  Windows that no block's maxima
can bring to a threshold are told in array passes and get no cursors.  Every
item that reaches its threshold, a share of the score it gives itself, is then
verified: word shingles of its question and of its answer must lie in the text
around the window.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import bounded_batches, ship_package
from strataframe.llm._text import PUNCTUATION, HashIndex, Texts, mix, slices, string_buffers

K1, B = 1.2, 0.75
#: Share of an item's own score that a window has to reach.
THRESHOLD = 0.5
#: Share of question and of answer shingles that must be found.
OVERLAP = 0.8
SHINGLE = 5
#: Words of a window at least; longer items make longer windows.  Windows overlap by half.
WINDOW = 64
#: Items of a block, and blocks of a block of blocks.  Bears on the work alone.
BLOCK = 4
#: Items and bytes of text that one broadcast index holds; more items make more passes, with the same scores.
INDEX_ITEMS, INDEX_BYTES = 1 << 16, 16 << 20
SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, at_word bigint"
_NEAR = 1 - 1e-6


def question_and_answer(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last line is the answer; else the last sentence; else the last third of the words."""
    lines = [x for x in re.split(r"\n+", text) if re.search(r"\w", x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.!?])\s+", text) if re.search(r"\w", x)]
    if len(lines) < 2:
        words = text.split()
        cut = len(words) - max(1, len(words) // 3)
        lines = [" ".join(words[:cut]), " ".join(words[cut:])]
    return " ".join(lines[:-1]), lines[-1]


def _words(text: str) -> np.ndarray:
    data, offsets = string_buffers(pa.array([text], pa.string()))
    texts = Texts(data, offsets)
    starts, ends, _ = texts.split(PUNCTUATION)
    return texts.hashes(starts, ends, lower=True)


def shingles(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Distinct keys of the word shingles of ``width`` words."""
    keys = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(keys)])
    return np.unique(keys)


@dataclass
class Corpus:
    """What the scores need to know of all items: their number, mean and greatest length, and the items with each term."""

    n: int
    mean_length: float
    longest: int
    terms: np.ndarray
    items_with: np.ndarray


@dataclass
class Index:
    """Posting lists of one part of the items; items are numbered by threshold."""

    items: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    least: np.ndarray
    parts: list[list[tuple[int, np.ndarray]]]
    length: np.ndarray
    window: int

    def open(self) -> Index:
        """Build lookup tables and block maxima (on the worker)."""
        self.find = HashIndex(self.terms).find
        self.top = np.maximum.reduceat(self.impact, self.first[:-1])
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        self.levels, size = [], BLOCK
        while True:
            key = term * (1 << 32) + self.item // size
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.levels.append((size, key[start], np.maximum.reduceat(self.impact, start), self.least[::size]))
            if len(self.items) <= size * BLOCK:
                break
            size *= BLOCK
        _, key, block_top, _ = self.levels[0]
        edge = np.searchsorted(key, np.arange(len(self.terms) + 1) << 32)
        #: Per list: items, impacts, blocks, their maxima, its maximum.
        self.lists = [
            (self.item[a:b], self.impact[a:b], (key[c:d] & ((1 << 32) - 1)), block_top[c:d], float(t))
            for a, b, c, d, t in zip(self.first[:-1], self.first[1:], edge[:-1], edge[1:], self.top, strict=True)
        ]
        return self


def gather(items: list[tuple[int, str]]) -> Corpus:
    """The whole corpus's numbers from items at hand."""
    words = [w for _, t in items if len(w := _words(t or ""))]
    terms, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, words)]), return_counts=True)
    length = [len(w) for w in words]
    return Corpus(len(words), sum(length) / max(len(words), 1), max(length, default=0), terms, n)


def build_index(items: list[tuple[int, str]], threshold: float = THRESHOLD, corpus: Corpus | None = None) -> Index | None:
    """Posting lists of ``items``, whose weights are those of the whole ``corpus``; items without words are left out."""
    known = [(i, w, t) for i, t in items if len(w := _words(t or ""))]
    if not known:
        return None
    corpus = corpus or gather(items)
    length = np.array([len(w) for _, w, _ in known])
    terms, at = np.unique(np.concatenate([w for _, w, _ in known]), return_inverse=True)
    row = np.repeat(np.arange(len(known)), length)
    pair, tf = np.unique(at * np.int64(len(known)) + row, return_counts=True)
    term, row = pair // len(known), pair % len(known)
    df = corpus.items_with[np.searchsorted(corpus.terms, terms)]
    idf = np.log(1 + (corpus.n - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / corpus.mean_length))
    least = threshold * np.bincount(row, impact, len(known))
    order = np.argsort(least, kind="stable")
    number = np.empty(len(known), np.int64)
    number[order] = np.arange(len(known))
    by = np.lexsort((number[row], term))
    parts = [[(n := min(SHINGLE, len(w)), shingles(w, n)) for w in map(_words, question_and_answer(known[k][2])) if len(w)] for k in order]
    first = np.searchsorted(term[by], np.arange(len(terms) + 1))
    return Index(np.array([known[k][0] for k in order], object), terms, first, number[row][by], impact[by], least[order], parts, length[order], max(WINDOW, corpus.longest))


def block_max_wand(index: Index, terms: list[int]) -> list[tuple[int, float]]:
    """All items that the query's distinct ``terms`` bring to their thresholds, with their scores."""
    lists = [index.lists[t] for t in terms]
    cursor, least = [0] * len(lists), index.least
    now = [int(x[0][0]) for x in lists]
    live = sorted(range(len(lists)), key=now.__getitem__)
    found: list[tuple[int, float]] = []

    def move(k: int, to: int) -> None:
        """Cursor of list k to its first item from ``to`` on."""
        items = lists[k][0]
        cursor[k] += int(np.searchsorted(items[cursor[k] :], to))
        now[k] = int(items[cursor[k]]) if cursor[k] < len(items) else -1

    while live:
        bound, pivot, last = 0.0, -1, 0
        for last, k in enumerate(live):
            bound += lists[k][4]
            # Thresholds grow with the items' numbers, so what falls short here does for all items in between.
            if bound >= least[now[k]] * _NEAR:
                pivot = now[k]
                break
        if pivot < 0:
            return found
        while last + 1 < len(live) and now[live[last + 1]] == pivot:
            last += 1
        block, bound = pivot // BLOCK, 0.0
        for k in live[: last + 1]:
            at = int(np.searchsorted(lists[k][2], block))
            if at < len(lists[k][2]) and lists[k][2][at] == block:
                bound += float(lists[k][3][at])
        if bound < least[pivot] * _NEAR:
            to = (block + 1) * BLOCK
            if last + 1 < len(live):
                to = min(to, now[live[last + 1]])
        elif now[live[0]] == pivot:
            score = math.fsum(float(lists[k][1][cursor[k]]) for k in live[: last + 1])
            if score >= least[pivot] * _NEAR:
                found.append((pivot, score))
            to = pivot + 1
        else:
            to = pivot
        for k in live[: last + 1]:
            if now[k] < to:
                move(k, to)
        live = sorted((k for k in live if now[k] >= 0), key=now.__getitem__)
    return found


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high-1, and which range each is of."""
    size = high - low
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size), which


def _open_windows(index: Index, begin: np.ndarray, size: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Windows (entries begin..begin+size-1 of ``term``) of which some block's maxima reach a threshold in it."""
    enough = np.add.reduceat(index.top[term], begin) >= index.least[0] * _NEAR
    window, block = np.flatnonzero(enough), None
    for width, key, top, least in reversed(index.levels):
        alive: list[tuple[np.ndarray, np.ndarray]] = []
        per = 4096
        for k in range(0, len(window), per):
            w = window[k : k + per]
            entry, which = _ranges(begin[w], begin[w] + size[w])
            base = term[entry] << 32
            low, high = (0, len(index.items)) if block is None else (block[k : k + per][which] * BLOCK, (block[k : k + per][which] + 1) * BLOCK)
            at, of = _ranges(np.searchsorted(key, base + low), np.searchsorted(key, base + high))
            met, place = np.unique(which[of] << 32 | (key[at] & ((1 << 32) - 1)), return_inverse=True)
            bound = np.bincount(place, top[at], len(met))
            b = met & ((1 << 32) - 1)
            fits = bound >= least[b] * _NEAR
            alive.append((w[met[fits] >> 32], b[fits]))
        if not alive:
            return np.zeros(0, np.int64)
        window, block = (np.concatenate(x) for x in zip(*alive, strict=True))
    return np.unique(window)


def retrieve(index: Index, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, window, item, score) of all windows and items that reach the item's threshold."""
    step = (index.window + 1) // 2
    count = np.diff(first)
    windows = np.maximum(1, -(-count // step) - 1) * (count > 0)
    first_window = np.concatenate([[0], np.cumsum(windows)])
    hit = np.flatnonzero(ids >= 0)
    doc = np.searchsorted(first, hit, "right") - 1
    own = (hit - first[doc]) // step
    entries = []
    for back in (0, 1):
        k = own - back
        ok = (k >= 0) & (k < windows[doc])
        entries.append(((first_window[doc[ok]] + k[ok]) * np.int64(len(index.terms))) + ids[hit[ok]])
    entries = np.unique(np.concatenate(entries))
    none = np.zeros(0, np.int64)
    if not len(entries):
        return none, none, none, np.zeros(0)
    window, term = entries // len(index.terms), entries % len(index.terms)
    begin = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    size = np.diff(np.append(begin, len(entries)))
    found = [(int(window[begin[w]]), i, x) for w in _open_windows(index, begin, size, term).tolist() for i, x in block_max_wand(index, term[begin[w] : begin[w] + size[w]].tolist())]
    if not found:
        return none, none, none, np.zeros(0)
    win, item, score = (np.array(x) for x in zip(*found, strict=True))
    d = np.searchsorted(first_window, win, "right") - 1
    return d, win - first_window[d], item, score


def held_items(known: Index, texts: Texts, overlap: float) -> dict[tuple[int, int], tuple[float, float, float, int]]:
    """(text, item) of a slice whose overlap is verified: score, both shares, first word of the best window."""
    starts, ends, first = texts.split(PUNCTUATION)
    words = texts.hashes(starts, ends, lower=True)
    step = (known.window + 1) // 2
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for d, w, item, score in zip(*(x.tolist() for x in retrieve(known, known.find(words), first)), strict=True):
        around = int(known.length[item])
        lo = max(first[d], first[d] + w * step - around)
        near = words[lo : min(first[d + 1], first[d] + w * step + known.window + around)]
        share = [float(np.isin(x, shingles(near, n)).mean()) for n, x in known.parts[item]]
        share = [1.0, *share][-2:]  # a single word is the answer alone
        if min(share) >= overlap and (score, *share) > best.get((d, item), (0.0,))[:3]:
            best[d, item] = (score, *share, int(w * step))
    return best


def _search(docs: DataFrame, index: Index, overlap: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.open()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for at, _, texts in slices(batch.column(1)):
                rows += [(keys[at + d], int(known.items[item]), *x) for (d, item), x in sorted(held_items(known, texts, overlap).items())]
            if rows:
                names = ("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "at_word")
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _search(docs: DataFrame, index: Index, overlap: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.open()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for at, _, texts in slices(batch.column(1)):
                rows += [(keys[at + d], known.items[item], *x) for (d, item), x in sorted(held_items(known, texts, overlap).items())]
            if rows:
                names = ("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "at_word")
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _item_terms(items: DataFrame) -> DataFrame:
    """part, key of each item's distinct words, and one row of each item's length with a null key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words(text or "")
                if len(words):
                    keys = np.unique(words).view(np.int64).tolist()
                    n = len(keys) + 1
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([None, *keys], pa.int64()), pa.array([len(words)] * n, pa.int64())], ["part", "key", "length"])

    return items.select("part", "text").mapInArrow(run, "part bigint, key bigint, length bigint")


def _indexes(benchmark: DataFrame, threshold: float) -> Iterator[Index]:
    """Indexes of bounded size over all items, one after the other, with the weights of all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
    passes = max(1, -(-n // INDEX_ITEMS), -(-size // INDEX_BYTES))
    while True:  # a part holds as much at most, or a single item
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
        most = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(bytes_).alias("size")).where((F.col("n") > 2 * INDEX_ITEMS) | ((F.col("size") > 2 * INDEX_BYTES) & (F.col("n") > 1)))
        if passes == 1 or passes >= 2 * n or most.isEmpty():
            break
        passes *= 2
    told = _item_terms(dealt)
    total = told.where("key is null").agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0)), F.coalesce(F.max("length"), F.lit(0))).first()
    items_with = told.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    for k in range(passes):
        part = dealt.where(F.col("part") == k).orderBy("item_id", "text").select("item_id", "text").collect()
        own = items_with if passes == 1 else items_with.join(told.where((F.col("part") == k) & F.col("key").isNotNull()).select("key").distinct(), "key")
        table = own.toArrow().combine_chunks()  # the distinct words of one part
        keys, counts = np.asarray(table["key"].to_numpy()).astype(np.int64).view(np.uint64), np.asarray(table["n"].to_numpy()).astype(np.int64)
        order = np.argsort(keys)
        if index := build_index([tuple(r) for r in part], threshold, Corpus(*total, keys[order], counts[order])):
            yield index


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """Every (doc_id, item_id) of a document that holds a test item, with its evidence.

    Per pair: the best window's BM25 score, the shares of question and answer
    shingles found, and the window's first word.  Items whose text is null or
    has no words match nothing, nor do such documents; repeated documents and
    repeated items each give their rows; ids may be null; other columns are
    ignored; an empty table on either side gives no rows.  Weights, mean length
    and window are those of the whole benchmark.  A benchmark over
    ``INDEX_ITEMS`` items or ``INDEX_BYTES`` bytes is read in parts, each a
    pass over the documents with a broadcast index of bounded size; where it
    is cut changes no row.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark, 256)
    out = None
    for index in _indexes(benchmark, threshold):
        found = _search(docs, index, overlap)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without those that hold a test item.

    Each row is judged by its own text as it passes by: nothing is joined or
    shuffled, and a null or repeated doc_id makes no difference.
    """
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession, 256)
    for index in _indexes(benchmark, threshold):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value.open()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, _, texts in slices(batch.column("text")):
                    keep[[at + d for d, _ in held_items(known, texts, overlap)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
