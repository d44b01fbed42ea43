"""Language-model scores from a probabilistic suffix tree over words.

The root is the smoothed distribution of single tokens.  A context (the last
one or more words) is a node if it comes before at least ``LEAST_CONTEXT``
training tokens and if its next-token distribution diverges from that of its
suffix by more than its description costs.  A node lists the next tokens seen
at least ``LEAST_ENTRY`` times after it; the rest of its mass goes to its
suffix.  Both are plain counts at every size of the corpus.  A context after
which only one token comes is not made longer, as longer ones tell the same,
and the first level without a node ends the tree.

Levels are written tables keyed by context and next token.  A token's gain over
the root is a sum of one value for each context before it and one for each
listed pair of context and token, so that texts are joined with one table of
such values.  Values met by at least a share ``ENTRY`` of the training tokens
are broadcast instead, a bounded number that spares the join its common keys.
Passes follow a context only as far as it was tried, by filters of hashed keys
whose false hits cost a lookup and change nothing.

Whether a context is a node hangs on its suffixes and on the tokens after it.
The first levels are passes over all texts, one each.  Below them few positions
are left, most of them in near copies, whose contexts stay frequent for long:
one pass sends what comes before each of these for 4, 16, 64 ... levels to the
shard of its context, which has all that these levels need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm import _blobs
from strataframe.llm._spark import bounded_batches, cleanup, materialize, release, ship_package
from strataframe.llm._text import _BASE, HashIndex, Tally, Texts, _power_tables, mix, segment_sums, slices

#: Share of the training tokens from which a word's count or a context's value is broadcast rather than joined.
ENTRY = 1e-6
#: Least counts of a context, and of a listed token after it.
LEAST_CONTEXT, LEAST_ENTRY = 10, 3
#: The most frequent words, at most so many, go through shuffles as short numbers.
SHORT_WORDS = 1 << 18
#: Bits of the filter that spares the shuffles most keys they don't need; any key it lets through is judged by a join.
FILTER_BITS = 27
#: Levels that are counted one by one, how many times more are counted at once in each pass after them, and at most.
SHALLOW, GROWTH, MOST_LEVELS = 3, 4, 128
#: Taken from each listed count for tokens that aren't listed.
DISCOUNT = 0.75
#: Key of the end of a document.
END = np.uint64(0x5851F42D4C957F2D)
_GAIN = 0x2545F4914F6CDD1D


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each document's words and then its end; first indices."""
    starts, ends, first = texts.split()
    words = texts.hashes(starts, ends, lower=True)
    last = first[1:] + np.arange(texts.n)
    keys = np.empty(len(words) + texts.n, np.uint64)
    body = np.ones(len(keys), bool)
    body[last] = False
    keys[last], keys[body] = END, words
    return keys, np.concatenate([[0], last + 1])


def _before(ids: np.ndarray, first: np.ndarray, back: int) -> np.ndarray:
    """``ids`` moved ``back`` tokens on within documents; -1 where there is none."""
    out = np.full(len(ids), -1, np.int64)
    if back < len(ids):
        out[back:] = ids[:-back]
    for k in range(back):
        at = first[:-1] + k
        out[at[at < first[1:]]] = -1
    return out


@dataclass
class Level:
    """Nodes of one depth; a node's key is made of its suffix's node and its first word."""

    contexts: np.ndarray
    total: np.ndarray
    back_off: np.ndarray = field(default_factory=lambda: np.zeros(0))
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    log_p: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    n: int
    v: int
    words: np.ndarray
    counts: np.ndarray
    levels: list[Level]

    def open(self) -> Tree:
        """Build the lookup tables (on the worker)."""
        self.index = HashIndex(self.words)
        self.nodes = [HashIndex(x.contexts) for x in self.levels]
        self.listed = [HashIndex(x.entries) for x in self.levels]
        self.base = np.log10((self.counts + 0.5) / (self.n + 0.5 * (self.v + 1)))
        return self

    def states(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each level the node that the tokens before each token lead to, or -1."""
        out: list[np.ndarray] = []
        for depth, index in enumerate(self.nodes):
            word = _before(ids, first, depth + 1)
            key = word if not depth else pair(out[-1], word)
            node = index.find(key.astype(np.uint64) if not depth else key)
            node[word < 0] = -1
            if depth:
                node[out[-1] < 0] = -1
            out.append(node)
        return out


def pair(node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One key of a node's number and a word's number (both under 2**31)."""
    return (node.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def _count(docs: DataFrame, keys_of, columns: str = "key bigint, n bigint") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, count = Tally(), keys_of()
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                tally.add(count(texts))
                if tally.full():
                    yield tally.take()
        if tally.size:
            yield tally.take()

    return docs.select("text").mapInArrow(run, columns).groupBy("key").agg(F.sum("n").alias("n"))


def _bounded(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a table whose size the thresholds bound."""
    table = df.select("key", "n").toArrow().combine_chunks()
    keys, n = (np.asarray(table[c].to_numpy()) for c in ("key", "n"))
    order = np.argsort(keys)
    return keys[order].astype(np.int64).view(np.uint64), n[order].astype(np.int64)


def grow(docs: DataFrame, counts: DataFrame, depth: int, context: float, entry: float) -> Tree:
    """Learn a tree of bounded depth in memory, for small corpora; :func:`score` uses :func:`learn`."""
    sc = docs.sparkSession.sparkContext
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, c = _bounded(counts.where(F.col("n") >= entry * n))
    tree = Tree(n, v, words, c, [])
    root = (c + 0.5) / (n + 0.5 * (v + 1))
    least = max(context * n, LEAST_CONTEXT)
    heads = np.flatnonzero((c >= least) & (words != END))
    level = Level(heads.astype(np.uint64), c[heads])
    for d in range(depth):
        if not len(level.contexts):
            break
        tree.levels.append(level)
        shared = sc.broadcast(Tree(n, v, words, c, tree.levels))

        def keys_of(shared=shared, d=d):
            known = shared.value.open()

            def count(texts: Texts) -> np.ndarray:
                keys, first = tokens(texts)
                ids = known.index.find(keys)
                node = known.states(ids, first)[d]
                both = (node >= 0) & (ids >= 0)
                return pair(node[both], ids[both])

            return count

        seen, times = _bounded(_count(docs, keys_of).where(F.col("n") >= max(entry * n, LEAST_ENTRY)))
        shared.destroy()
        node, word = (seen >> np.uint64(32)).astype(np.int64), (seen & np.uint64(2**32 - 1)).astype(np.int64)
        below = root[word] if not d else _probability(tree, d - 1, _suffix(tree, d, node), word, root)
        p = (times - DISCOUNT) / level.total[node]
        listed = np.bincount(node, p, len(level.contexts))
        lower = np.minimum(np.bincount(node, below, len(level.contexts)), 1 - 1e-9)
        rest = np.maximum(1 - listed, 1e-12)
        level.back_off = np.log10(rest / (1 - lower))
        divergence = np.bincount(node, p * np.log(p / below), len(level.contexts)) + rest * np.log(rest / (1 - lower))
        size = np.bincount(node, minlength=len(level.contexts))
        retained = level.total * divergence > 0.5 * (size + 1) * np.log(level.total + 1)
        level.back_off[~retained] = 0.0  # it passes everything on; longer contexts are tried below any node
        level.entries, level.log_p = seen[retained[node]], np.log10(p)[retained[node]]
        longer = np.flatnonzero((times >= least) & (words[word] != END))
        x, w = node[longer], word[longer]
        keys = pair(_extend(tree, d - 1, _suffix(tree, d, x), w), _first_word(tree, d, x))
        order = np.argsort(keys)
        level = Level(keys[order], times[longer][order])
    return tree


def _suffix(tree: Tree, d: int, node: np.ndarray) -> np.ndarray:
    """Node of level d - 1 that the node's context has without its first word (0 for the root)."""
    return (tree.levels[d].contexts[node] >> np.uint64(32)).astype(np.int64) if d else np.zeros(len(node), np.int64)


def _first_word(tree: Tree, d: int, node: np.ndarray) -> np.ndarray:
    return (tree.levels[d].contexts[node] & np.uint64(2**32 - 1)).astype(np.int64)


def _extend(tree: Tree, d: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Node of level d + 1 of the context of ``node`` (level d, -1 the root) and a next word."""
    if d < 0:
        key = word.astype(np.uint64)
    else:
        key = pair(_extend(tree, d - 1, _suffix(tree, d, node), word), _first_word(tree, d, node))
    return HashIndex(tree.levels[d + 1].contexts).find(key)


def _probability(tree: Tree, d: int, node: np.ndarray, word: np.ndarray, root: np.ndarray) -> np.ndarray:
    """P(word | node of level d) with what its suffix gives."""
    level = tree.levels[d]
    at = HashIndex(level.entries).find(pair(node, word))
    below = root[word] if not d else _probability(tree, d - 1, _suffix(tree, d, node), word, root)
    return np.where(at >= 0, 10 ** level.log_p[np.maximum(at, 0)] if len(level.log_p) else 0.0, 10 ** level.back_off[node] * below)


def training_rows(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 != 1


class Runs:
    """Keys of runs of a slice's tokens, read off one prefix sum; that of one token is the token's own.

    A context's key is that of the run of tokens it is, so that the count of a
    listed pair is the count of the longer context it makes.  ``room`` has the
    number of tokens before each in its document.
    """

    def __init__(self, texts: Texts | None = None, words: np.ndarray | None = None, first: np.ndarray | None = None):
        self.words, first = (words, first) if texts is None else tokens(texts)
        power, self.inverse = _power_tables(len(self.words) + 1)
        self.sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * power[:-1], out=self.sums[1:])
        self.first = first
        self.room = np.arange(len(self.words)) - np.repeat(first[:-1], np.diff(first))

    def sum(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def key(self, start: np.ndarray, length: int) -> np.ndarray:
        return _run_key(self.sum(start, length), length) if length > 1 else self.words[start]

    def least(self, at: np.ndarray, length: int, gram: int) -> np.ndarray:
        """Least key of a run of ``gram`` of the ``length`` tokens before each place."""
        grams = self.key(np.arange(max(0, len(self.words) - gram + 1)), gram)
        width, out = length - gram + 1, np.full(len(at), np.uint64(2**64 - 1))
        done = 1
        while 2 * done <= width:  # grams[i] is the least of as many from i on as were taken together
            grams[: len(grams) - done] = np.minimum(grams[:-done], grams[done:])
            done *= 2
        return np.minimum(grams[at - length], grams[at - gram - done + 1], out=out)


def _run_key(total: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    return mix(total + np.uint64(length))


def _longer(total: np.ndarray, length: int, token: np.ndarray) -> np.ndarray:
    """Sum of a run of ``length`` tokens with a sum, and one more token."""
    return total + token * np.uint64(pow(_BASE, length, 2**64))


def context_keys(runs: Runs, tried, open_) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth: the tokens after a tried context, keys of these contexts, and of context and token.

    A longer context is followed only where its suffix is open; ``tried`` and
    ``open_`` may let others through, but miss none.
    """
    at, d = np.flatnonzero(runs.room), 1
    while len(at):
        context = runs.key(at - d, d)
        use = tried(context)
        at, context = at[use], context[use]
        yield at, context, runs.key(at - d, d + 1)
        at = at[open_(context) & (runs.room[at] > d)]
        d += 1


def scored_runs(runs: Runs, contexts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the last tokens and keys of the runs that can have a value, each once.

    A run's value is that of the listed pair that it is and that of the
    context that it is before the next token.  A value says by itself that all
    shorter ones it hangs on are there, so that a run met on either way will do.
    """
    mark, end, key = np.zeros(len(runs.words), bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for here, context, pair_key in contexts:
        mark[here - 1] = True
        other = ~mark[end]
        yield np.concatenate([here - 1, end[other]]), np.concatenate([context, key[other]])
        mark[here - 1] = False
        end, key = here, pair_key
    yield end, key


class Filter:
    """Bits of hashed keys: no false misses, and a size that doesn't grow."""

    def __init__(self, df: DataFrame | None = None):
        self.bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        if df is not None:
            self.add(df)

    def add(self, df: DataFrame) -> None:
        key = F.shiftrightunsigned("key", 64 - FILTER_BITS)
        words = df.select(F.shiftright(key, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 AS INT))").alias("bit"))
        with cleanup(df.sparkSession):
            table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().combine_chunks()
        if table.num_rows:
            self.bits[table["word"].to_numpy()] |= table["bits"].to_numpy().view(np.uint64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - FILTER_BITS)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and how often it is there."""
    order = np.argsort(keys)
    start = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    return order[start], np.diff(np.append(start, len(keys)))


def _frequent(counts: DataFrame) -> np.ndarray:
    """The most frequent words, at most ``SHORT_WORDS``, the most frequent first."""
    words, n = _bounded(counts.where(F.col("n") >= _share(counts, 1, SHORT_WORDS)))
    return words[np.argsort(-n, kind="stable")]


def _decoded(code: np.ndarray, bits: int, size: int, frequent: np.ndarray) -> list[np.ndarray]:
    """The ``size`` words of each code, first to last."""
    return [frequent[((code >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)] for k in range(size)]


def _words_key(words: list[np.ndarray]) -> np.ndarray:
    """Keys of runs of words, given by first words, second words ..."""
    total = words[0]
    for k, word in enumerate(words[1:], 1):
        total = _longer(total, k, word)
    return _run_key(total, len(words)) if len(words) > 1 else total


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key seen often enough to be listed, and its count."""
    order = np.argsort(keys)
    start = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    n = np.add.reduceat(n[order], start)
    use = n >= LEAST_ENTRY
    return order[start[use]], n[use]


#: Blobs of pairs: keys, and codes of the most frequent words.
_KEYS, _CODES = range(2)


def _pairs(train: DataFrame, d: int, filters) -> DataFrame:
    """key, ctx, below, n of the pairs of a context of depth ``d`` and a next token seen often enough.

    Where all of its words are among the most frequent, a pair goes as a code of their numbers.
    """
    count, bits = _blobs.shards(train.sparkSession), min(SHORT_WORDS.bit_length() - 1, 64 // (d + 1))
    width = -(-bits * (d + 1) // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counted, often, frequent), parts, codes, size = filters.value, [], [], 0
        index = HashIndex(frequent[: 1 << bits])

        def take() -> Iterator[pa.RecordBatch]:
            key, ctx, below = (np.concatenate(c) for c in zip(*parts, strict=True))
            if len(key):
                one, n = _first_of(key)
                key, ctx, below = key[one], ctx[one], below[one]
                yield _blobs.pack(_blobs.shard_of(key, count), [ctx, below] if d == 1 else [ctx, below, key], n, _KEYS)
            code = np.sort(np.concatenate(codes))
            if len(code):
                start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                code, n = code[start], np.diff(np.append(start, len(code)))
                yield _blobs.pack_codes(_blobs.shard_of(_words_key(_decoded(code, bits, d + 1, frequent)), count), code, n, width, _CODES)

        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                runs = Runs(texts)
                at = np.flatnonzero(runs.room >= d)
                ctx = runs.key(at - d, d)
                use = counted(ctx)
                at, ctx = at[use], ctx[use]
                below = runs.key(at - d + 1, d)
                use = often(below)
                at, ctx, below = at[use], ctx[use], below[use]
                ids = index.find(runs.words)
                others = np.concatenate([[0], np.cumsum(ids < 0)])
                other = others[at + 1] > others[at - d]
                coded = at[~other]
                code = np.zeros(len(coded), np.uint64)
                for k in range(d + 1):
                    code |= ids[coded - d + k].astype(np.uint64) << np.uint64(bits * k)
                at = at[other]
                codes.append(code)
                parts.append((runs.key(at - d, d + 1), ctx[other], below[other]))
                size += 8 * len(code) + 24 * len(at)
                if size >= _blobs.BUFFER_BYTES:
                    yield from take()
                    parts, codes, size = [], [], 0
        if size:
            yield from take()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key: np.ndarray, ctx: np.ndarray, below: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in (key, ctx, below)), pa.array(n)], ["key", "ctx", "below", "n"])

        blobs = _blobs.gather(batches)
        if _KEYS in blobs:
            (ctx, below, *key), n = _blobs.unpack(blobs.pop(_KEYS), 2 if d == 1 else 3)
            key = key[0] if key else _run_key(_longer(ctx, 1, below), 2)
            one, n = _summed(key, n)
            yield told(key[one], ctx[one], below[one], n)
        if _CODES in blobs:
            code, n = _blobs.unpack_codes(blobs.pop(_CODES), width)
            one, n = _summed(code, n)
            words = _decoded(code[one], bits, d + 1, filters.value[2])
            yield told(_words_key(words), _words_key(words[:-1]), _words_key(words[1:]), n)

    return _blobs.deal(train.mapInArrow(run, _blobs.SCHEMA)).mapInArrow(listed, "key bigint, ctx bigint, below bigint, n bigint")


#: What a row of deeper levels tells: a listed pair's value, a node's value, a context on the way to a node (value 1 if it isn't that node), a pair for the next levels.
_VALUE, _NODE, _PATH, _PAIR = range(4)
_LEVELS_SCHEMA = "kind int, depth int, ctx bigint, least bigint, key bigint, value double, n bigint"


def _levels(train: DataFrame, parent: DataFrame, filters, d: int, more: int, least: float, gram: int) -> DataFrame:
    """Rows of ``more`` levels from depth ``d``, each shard with all that is below some contexts of depth ``d - 1``.

    ``parent`` has ctx, key and p of the listed pairs of the open contexts of
    depth ``d - 1``, and in ``least`` each context's least run of ``gram``
    tokens.  Whether a context is a node depends on its suffixes and on the
    tokens after it only, and all of these are in its shard.  Neighbours with
    one least run are sent as one run of tokens, as they share what is before.
    """
    count = _blobs.shards(train.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (open_, counted, frequent), parts, size = filters.value, [], 0
        known = HashIndex(frequent)

        def take() -> pa.RecordBatch:
            key, shard, length, lead, sent = (np.concatenate(c) for c in zip(*parts, strict=True))
            starts = np.cumsum(length) - length
            one, n = _first_of(key)
            return _blobs.pack_runs(shard[one], length[one], lead[one], n, starts[one], sent, known=known)

        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                runs = Runs(texts)
                at = np.flatnonzero(runs.room >= d)
                use = open_(_run_key(runs.sum(at - d + 1, d - 1), d - 1))
                at = at[use]
                if counted is not None:
                    at = at[counted(runs.key(at - d, d))]
                if not len(at):
                    continue
                # The least run of a context's tokens says the shard, so that neighbours go together and share what is before them.
                least_run = runs.least(at, d - 1, gram)
                fresh = np.concatenate([[True], (np.diff(at) > 1) | (least_run[1:] != least_run[:-1])])
                first = np.flatnonzero(fresh)
                lead = np.minimum(runs.room[at[first]], d + more - 1)
                start = at[first] - lead
                length = lead + np.diff(np.append(first, len(at)))
                key = mix(mix(runs.sum(start, length) + length.astype(np.uint64)) + lead.astype(np.uint64))
                parts.append((key, _blobs.shard_of(least_run[first], count), length, lead, runs.words[_blobs.spread(start, length)]))
                size += int(length.sum()) + 5 * len(first)
                if 8 * size >= _blobs.BUFFER_BYTES:
                    yield take()
                    parts, size = [], 0
        if size:
            yield take()

    def send_parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, key, p, run = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            if len(ctx):
                yield _blobs.pack(_blobs.shard_of(run.view(np.uint64), count), [ctx, key, p], np.ones(len(ctx), np.int64), 1)

    def rows(kind: int, depth: int, key: np.ndarray, value: np.ndarray, n: np.ndarray | None = None, ctx: np.ndarray | None = None, run: np.ndarray | None = None) -> pa.RecordBatch:
        none = np.zeros(len(key), np.int64)
        wide = [none if x is None else x.view(np.int64) for x in (ctx, run)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(np.full(len(key), depth, np.int32)), pa.array(wide[0]), pa.array(wide[1]), pa.array(key.view(np.int64)), pa.array(value.astype(float)), pa.array(none if n is None else n.astype(np.int64))],
            ["kind", "depth", "ctx", "least", "key", "value", "n"],
        )

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _blobs.gather(batches)
        if 0 not in blobs or 1 not in blobs:
            return
        (p_ctx, p_key, p_value), _ = _blobs.unpack(blobs.pop(1), 3)
        length, lead, times, words = _blobs.unpack_runs(blobs.pop(0), filters.value[2])
        runs = Runs(words=words, first=np.concatenate([[0], np.cumsum(length)]))
        at = _blobs.spread(runs.first[:-1] + lead, length - lead)
        n, room, token = np.repeat(times, length - lead), runs.room[at], words[at]
        top = runs.sum(at - d + 1, d - 1)
        order = np.argsort(p_key)
        p_key, p_value = p_key[order], p_value.view(float)[order]
        live = np.flatnonzero(np.isin(_run_key(top, d - 1), p_ctx))
        key = _run_key(_longer(top[live], d - 1, token[live]), d)
        known = np.minimum(np.searchsorted(p_key, key), len(p_key) - 1)
        lower_p = np.full(len(top), np.nan)  # what is not listed is not listed after a longer context
        lower_p[live] = np.where(p_key[known] == key, p_value[known], np.nan)
        ends, depths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # of nodes, the place after it and its depth
        for depth in range(d, d + more):
            live = live[room[live] >= depth]
            if not len(live):
                break
            total_of = runs.sum(at[live] - depth, depth)
            _, one, group = np.unique(total_of, return_index=True, return_inverse=True)
            total, sample = np.bincount(group, n[live]), at[live[one]]
            ctx = _run_key(total_of[one], depth)
            enough = (total >= least)[group]
            live, group, total_of = live[enough], group[enough], total_of[enough]
            if not len(live):
                break
            key, one, pair_of = np.unique(_run_key(_longer(total_of, depth, token[live]), depth + 1), return_index=True, return_inverse=True)
            times, owner, q = np.bincount(pair_of, n[live]), group[one], lower_p[live][one]
            top_times = np.zeros(len(total))
            np.maximum.at(top_times, owner, times)
            many = times >= LEAST_ENTRY
            key_, times_, owner_, q_ = key[many], times[many], owner[many], q[many]
            p = (times_ - DISCOUNT) / total[owner_]
            size = np.bincount(owner_, minlength=len(total))
            rest = np.maximum(1 - np.bincount(owner_, p, len(total)), 1e-12)
            lower = np.minimum(np.bincount(owner_, q_, len(total)), 1 - 1e-9)
            passed = np.log(rest / (1 - lower))
            gain = total * (np.bincount(owner_, p * np.log(p / q_), len(total)) + rest * passed)
            kept = (size > 0) & (gain > 0.5 * (size + 1) * np.log(total + 1))
            back_off = passed / math.log(10)
            node, open_now = np.flatnonzero(kept), top_times < total
            yield rows(_NODE, depth, ctx[node], back_off[node], total[node])
            told = kept[owner_]
            yield rows(_VALUE, depth, key_[told], np.log10(p[told] / q_[told]) - back_off[owner_[told]], times_[told])
            ends.append(sample[node])
            depths.append(np.full(len(node), depth))
            final = q.copy()
            final[many] = np.where(told, p, q_)
            final[~many] = np.nan
            lower_p[live] = final[pair_of]
            if depth == d + more - 1:
                use = many & open_now[owner]
                run = runs.least(sample, depth, (depth + 1) // 2)[owner[use]]
                yield rows(_PAIR, depth, key[use], final[use], ctx=ctx[owner[use]], run=run)
            live = live[open_now[group]]
        # Scoring follows only contexts on the way to a node: each node's own and its suffixes below the levels that are passes of their own.
        end, depth = np.concatenate(ends), np.concatenate(depths)
        steps = depth - SHALLOW + 1
        length, depth, end = _blobs.spread(np.full(len(end), SHALLOW), steps), np.repeat(depth, steps), np.repeat(end, steps)
        total = runs.sum(end - length, length)
        path = np.where(length > 1, _run_key(total, length.astype(np.uint64)), total)
        for deep in np.unique(depth):
            here = depth == deep
            keys, one = np.unique(path[here], return_index=True)
            yield rows(_PATH, int(deep), keys, length[here][one] < deep)

    sent = train.mapInArrow(send, _blobs.SCHEMA).unionByName(parent.select("ctx", "key", "p", "least").mapInArrow(send_parent, _blobs.SCHEMA))
    return _blobs.deal(sent).mapInArrow(grown, _LEVELS_SCHEMA)


def learn(train: DataFrame, counts: DataFrame, n: int, v: int, depth: int | None = None, context: float = 0.0) -> tuple[list[DataFrame], Filter, Filter, int, list[DataFrame]]:
    """Tables key, value, n of levels, filters of the contexts that scoring tries and makes longer, the tree's
    depth, and the written tables that the former are read from.

    A table has a node's back-off by its context, and a listed token's value
    by context and token; where these are the same tokens, n is the same too.  The first levels are counted one by one, as their
    contexts may be too common for one task; deeper ones many at once.
    """
    sc = train.sparkSession.sparkContext
    least = max(context * n, LEAST_CONTEXT)
    last = math.inf if depth is None else depth
    below = counts.where(F.col("n") >= LEAST_ENTRY).select("key", ((F.col("n") + 0.5) / F.lit(n + 0.5 * (v + 1))).alias("p"))
    counted = counts.where(F.col("n") >= least)
    contexts = counted.select(F.col("key").alias("ctx"), F.col("n").alias("total"))
    levels, spent, d, known, open_, often, frequent = [], [], 0, Filter(), Filter(), Filter(below), _frequent(counts)
    while d < min(last, SHALLOW):
        d += 1
        filters = sc.broadcast((Filter(counted), often, frequent))
        found = materialize(_pairs(train, d, filters), f"suffix-tree-found-{d}")
        filters.destroy()
        spent.append(found)
        listed = found.join(contexts, "ctx").join(below.select(F.col("key").alias("below"), F.col("p").alias("q")), "below")
        listed = materialize(listed.select("key", "ctx", "n", "total", ((F.col("n") - DISCOUNT) / F.col("total")).alias("p"), "q"), f"suffix-tree-listed-{d}")
        told = listed.groupBy("ctx").agg(
            F.max("total").alias("total"), F.max("n").alias("top"), F.count("*").alias("size"), F.greatest(1 - F.sum("p"), F.lit(1e-12)).alias("rest"),
            F.least(F.sum("q"), F.lit(1 - 1e-9)).alias("lower"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("divergence"),
        )
        rest = F.log(F.col("rest") / (1 - F.col("lower")))
        gain = F.col("total") * (F.col("divergence") + F.col("rest") * rest)
        kept = gain > 0.5 * (F.col("size") + 1) * F.log(F.col("total") + 1)
        tried = materialize(told.select("ctx", "total", "top", F.when(kept, rest / math.log(10)).alias("back_off")), f"suffix-tree-contexts-{d}")
        spent += [listed, tried]
        nodes = tried.where("back_off is not null")
        if nodes.isEmpty():
            return levels, known, open_, d - 1, spent
        known.add(tried.select(F.col("ctx").alias("key")))
        told = materialize(listed.join(nodes.select("ctx", "back_off"), "ctx", "left"), f"suffix-tree-level-{d}")
        spent.append(told)
        values = told.where("back_off is not null").select("key", (F.log10(F.col("p") / F.col("q")) - F.col("back_off")).alias("value"), "n")
        levels.append(values.unionByName(nodes.select(F.col("ctx").alias("key"), F.col("back_off").alias("value"), F.col("total").alias("n"))))
        below = told.select("ctx", "key", F.when(F.col("back_off").isNull(), F.col("q")).otherwise(F.col("p")).alias("p"))
        # A context with a single next token isn't made longer, nor is what was not tried for that; one without a listed token makes no longer listed pair.
        longer = tried.where("top < total").select(F.col("ctx").alias("below"))
        if d < SHALLOW:  # the last of these levels is made longer where a deeper node asks for it
            open_.add(longer.select(F.col("below").alias("key")))
        counted, often = found.where(F.col("n") >= least), Filter(found)
        contexts = counted.join(longer, "below", "left_semi").select(F.col("key").alias("ctx"), F.col("n").alias("total"))
    parent = (below.join(longer.select(F.col("below").alias("ctx")), "ctx", "left_semi") if d else below).withColumn("least", F.col("ctx") if d else F.col("key"))
    more, ready, gram = 4, Filter(counted), d
    while d < last:
        more = int(min(more, last - d))
        filters = sc.broadcast((Filter(parent.select(F.col("ctx").alias("key"))), ready, frequent))
        block = materialize(_levels(train, parent, filters, d + 1, more, least, gram), f"suffix-tree-levels-{d + 1}")
        filters.destroy()
        spent.append(block)
        filled = {r[0] for r in block.where(F.col("kind") == _NODE).select("depth").distinct().collect()}
        end = next((k for k in range(d + 1, d + more + 1) if k not in filled), d + more + 1)
        whole = block.where(F.col("depth") < end)
        levels.append(whole.where(F.col("kind").isin(_VALUE, _NODE)).select("key", "value", "n"))
        known.add(whole.where(F.col("kind") == _PATH).select("key"))
        open_.add(whole.where((F.col("kind") == _PATH) & (F.col("value") > 0)).select("key"))
        if end <= d + more:
            return levels, known, open_, end - 1, spent
        parent = block.where(F.col("kind") == _PAIR).select("ctx", "key", F.col("value").alias("p"), "least")
        d, more, ready = d + more, min(GROWTH * more, MOST_LEVELS), None
        gram = (d + 1) // 2
    return levels, known, open_, d, spent


#: Blobs of scoring: keys that rows ask for, the values of such keys, rows, what was found for them, and runs of two and three frequent words that rows ask for.
_ASKED, _WORTH, _ROW, _SUM, _ASKED_TWO, _ASKED_THREE = range(6)
#: Words, bits a word and bytes of the latter.
_CODED = {_ASKED_TWO: (2, 18, 5), _ASKED_THREE: (3, 18, 7)}


def _gain_key(key):
    """Key of a context's or pair's value, apart from a word's (a column or an array)."""
    return key.bitwiseXOR(F.lit(_GAIN)) if isinstance(key, Column) else key ^ np.uint64(_GAIN)


def _share(values: DataFrame, least: float, limit: int) -> float:
    """The first of ``least`` and it times 2 to the power 1/4, 2/4 ... from which at most ``limit`` values are met as often."""
    step = F.floor(4 * F.log2(F.col("n") / F.lit(max(least, 1e-9)))).cast("int")
    sizes = dict(tuple(r) for r in values.where(F.col("n") >= least).groupBy(step.alias("step")).agg(F.count("*")).collect())
    k = 0
    while sum(c for s, c in sizes.items() if s >= k) > limit:
        k += 1
    return least * 2 ** (k / 4) * (1 + 1e-9 * (k > 0))


def score(docs: DataFrame, depth: int | None = None, context: float = 0.0, entry: float = ENTRY) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are the end token alone.  A null doc_id counts as the
    empty text in the split.  Repeated rows each get a row and count each.  An
    empty table gives an empty result; without training tokens all
    probabilities are those of an unseen token.  Other columns are ignored.
    The tree has no greatest depth and no least share of a context unless
    asked; ``entry`` bears on what is broadcast only, not on results: the
    ``1 / entry`` words and values met most, of words at most ``SHORT_WORDS``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    train = docs.where(training_rows(F.col("doc_id"))).select("text")
    counts = materialize(_count(train, lambda: lambda texts: tokens(texts)[0]), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = _share(counts, 1, min(SHORT_WORDS, int(1 / entry)))
    words, c = _bounded(counts.where(F.col("n") >= frequent))
    levels, tried, open_, depth, spent = learn(train, counts, n, v, depth, context)
    empty = spark.createDataFrame([], "key bigint, value double, n bigint")
    values = materialize(reduce(DataFrame.unionByName, levels, empty), "suffix-tree-values")
    release(*spent)
    often = _share(values, 1, int(1 / entry))
    common = values.where(F.col("n") >= often).select("key", "value").toArrow().combine_chunks()
    smoothed = lambda k: (k + 0.5) / (n + 0.5 * (v + 1))
    few_words = counts.where(F.col("n") < frequent).select("key", F.log10(smoothed(F.col("n"))).alias("value"), F.lit(True).alias("base"))
    gains = values.select(_gain_key(F.col("key")).alias("key"), "value", F.lit(False).alias("base"), "n")
    few = few_words.unionByName(gains.where(F.col("n") < often).drop("n"))
    keys, place = np.unique(np.asarray(common["key"].to_numpy()).view(np.uint64), return_inverse=True)
    worth = np.bincount(place, common["value"].to_numpy(), len(keys))
    wanted = Filter(few_words.select("key").unionByName(gains.select("key")))
    shared = spark.sparkContext.broadcast((words, np.log10(smoothed(c)), keys, worth, wanted, tried, open_, depth))
    count, unseen = _blobs.shards(spark), math.log10(smoothed(0))
    lookups = -(-count // 4)  # a row gets one sum from each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, word_base, common, worth, wanted, tried, open_, deep = shared.value
        word_index, index = HashIndex(words), HashIndex(common)
        row, parts, coded, rows, size = TaskContext.get().partitionId() << 40, [], {k: [] for k in _CODED}, [], 0

        def take() -> Iterator[pa.RecordBatch]:
            asked, asking = (np.concatenate(c) for c in zip(*parts, strict=True))
            first = int(rows[0][0][0])
            yield _blobs.pack_asked(_blobs.shard_of(mix(asked), lookups), asked, asking, first, _ASKED)
            for kind, (_, _, width) in _CODED.items():
                if coded[kind]:
                    asked, code, asking = (np.concatenate(c) for c in zip(*coded[kind], strict=True))
                    yield _blobs.pack_asked(_blobs.shard_of(mix(asked), lookups), code, asking, first, kind, width)
            told = [np.concatenate(c) for c in zip(*rows, strict=True)]
            yield _blobs.pack(_blobs.shard_of(mix(told[0].view(np.uint64)), count), told, np.ones(len(told[0]), np.int64), _ROW)

        for batch in batches:
            ids = batch.column(0)
            for at, to, texts in slices(batch.column(1)):
                runs = Runs(texts)
                keys, first = runs.words, runs.first
                ids_of = word_index.find(keys)
                rare = ids_of < 0
                base = np.where(rare, 0.0, word_base[ids_of]) if len(word_base) else np.zeros(len(keys))
                others = np.concatenate([[0], np.cumsum(rare)])
                number = np.arange(row, row + texts.n)
                row += texts.n
                row_of = np.repeat(number, np.diff(first))
                todo = np.flatnonzero(rare & wanted(keys))
                gain, places, asked = np.zeros(len(keys)), [todo], [keys[todo]]
                for length, (end, key) in enumerate(scored_runs(runs, islice(context_keys(runs, tried, open_), deep)), 1):
                    use = wanted(_gain_key(key))
                    end, key = end[use], key[use]
                    found = index.find(key)
                    hit = found >= 0
                    gain[end[hit]] += worth[found[hit]]
                    end, key = end[~hit], _gain_key(key[~hit])
                    for kind, (size_, bits, _) in _CODED.items():
                        if size_ == length:
                            short = others[end + 1] == others[end + 1 - length]
                            code = np.zeros(int(short.sum()), np.uint64)
                            for k in range(length):
                                code |= ids_of[end[short] - length + 1 + k].astype(np.uint64) << np.uint64(bits * k)
                            coded[kind].append((key[short], code, row_of[end[short]]))
                            size += 24 * len(code)
                            end, key = end[~short], key[~short]
                    places.append(end)
                    asked.append(key)
                parts.append((np.concatenate(asked), row_of[np.concatenate(places)]))
                doc = ids[at:to]
                known = segment_sums((~rare).astype(np.int64), first)
                rows.append((number, np.asarray(doc.fill_null(0).to_numpy(zero_copy_only=False)), np.asarray(doc.is_null().to_numpy(zero_copy_only=False)).astype(np.int64), np.diff(first), known, segment_sums(base, first), segment_sums(gain, first)))
                size += 16 * len(parts[-1][0]) + 56 * texts.n
                if size >= _blobs.BUFFER_BYTES // 2 or row - int(rows[0][0][0]) >= 32768:
                    yield from take()
                    parts, coded, rows, size = [], {k: [] for k in _CODED}, [], 0
        if rows:
            yield from take()

    def send_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, value, base = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            if len(key):
                yield _blobs.pack(_blobs.shard_of(mix(key.view(np.uint64)), lookups), [key, value, base.astype(np.int64)], np.ones(len(key), np.int64), _WORTH)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list] = {}
        for batch in batches:
            for k, (kind, blob) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if kind == _ROW:
                    yield batch.slice(k, 1)
                else:
                    blobs.setdefault(kind, []).append(blob.as_buffer())
        if _WORTH not in blobs:
            return
        (key, value, base), _ = _blobs.unpack(blobs.pop(_WORTH), 3)
        key, one, place = np.unique(key, return_index=True, return_inverse=True)
        index, value, base, parts, size = HashIndex(key), np.bincount(place, value.view(float)), base[one] > 0, [], 0
        frequent = shared.value[0]

        def take() -> pa.RecordBatch:
            row, *sums = (np.concatenate(c) for c in zip(*parts, strict=True))
            return _blobs.pack(_blobs.shard_of(mix(row), count), [row, *sums], np.ones(len(row), np.int64), _SUM)

        for kind, blob in ((k, blob) for k in (_ASKED, *_CODED) for blob in blobs.pop(k, [])):  # it has all that its rows ask of this shard, by rows
            if kind == _ASKED:
                asked, row = _blobs.unpack_asked([blob])
            else:
                words, bits, width = _CODED[kind]
                code, row = _blobs.unpack_asked([blob], width)
                asked = _gain_key(_words_key(_decoded(code, bits, words, frequent)))
            at = index.find(asked)
            at, row = at[at >= 0], row[at >= 0]
            if len(row):
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                is_base, worth = base[at], value[at]
                parts.append((row[start], *(np.add.reduceat(w, start) for w in (is_base.astype(float), np.where(is_base, worth, 0.0), np.where(is_base, 0.0, worth)))))
                size += 32 * len(start)
                if size >= _blobs.BUFFER_BYTES // 2:
                    yield take()
                    parts, size = [], 0
        if size:
            yield take()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = _blobs.gather(batches)
        if _ROW not in blobs:
            return
        (row, doc, null, size, known, base, gain), _ = _blobs.unpack(blobs.pop(_ROW), 7)
        (r_row, *sums), _ = _blobs.unpack(blobs.pop(_SUM, []), 4)
        order = np.argsort(row)
        at = order[np.searchsorted(row[order], r_row)] if len(r_row) else np.zeros(0, np.int64)
        more_known, more_base, more_gain = (np.bincount(at, x.view(float), len(row)) for x in sums)
        size, known = size.view(np.int64), known.view(np.int64) + np.rint(more_known).astype(np.int64)
        base = base.view(float) + more_base + (size - known) * unseen
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc.view(np.int64), mask=null > 0), pa.array(size), pa.array(known), pa.array(base), pa.array(base + gain.view(float) + more_gain)], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        )

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _blobs.SCHEMA).unionByName(few.mapInArrow(send_few, _blobs.SCHEMA))
    looked_up = _blobs.deal(sent, lookups).mapInArrow(look_up, _blobs.SCHEMA)
    whole = _blobs.deal(looked_up).mapInArrow(add, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return whole.select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
