"""Packing token sequences into windows by best-fit decreasing.

Documents are tokenised, ended by ``end_id`` and cut into full windows; what
remains of each is placed, longest first, into the open window with the least
room that still takes it.  A segment tree over remaining capacities finds that
window.  Every task packs the documents of its own partition, so nothing is
shuffled and only piece records are held, ``FLUSH`` remainders at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strataframe.llm._spark import bounded_batches, ship_package
from strataframe.llm._text import HashIndex, Texts, slices

#: Remainders that a task packs together at most.
FLUSH = 200_000
#: Words whose ids a worker remembers at most; then it starts anew.
CACHED_WORDS = 600_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordTokenizer:
    """Ids of whole texts, from the ids of their distinct words.

    Holds for tokenizers whose tokens never span ASCII white space and whose
    rules for a word don't look past it, as the normaliser and pre-tokenizer of
    the word-level BPE file do.
    """

    MARKS = ("<|startoftext|>", "<|endoftext|>")
    #: ASCII punctuation that makes a token group of its own after letters.
    TAIL = frozenset('.,;:!?"()[]{}|&%$#*+-/<=>@')
    #: Characters that stand for the bytes which don't stand for themselves.
    BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.mark = self.tokenizer.token_to_id(self.MARKS[1])
        self.model = self.tokenizer.model
        self.tail = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in self.TAIL}
        self.clear()

    def clear(self) -> None:
        self.known = HashIndex(np.zeros(0, np.uint64))
        self.ids = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.first = np.zeros(1 << 14, np.int64)

    def _letters(self, word: str) -> list[int] | None:
        """Ids of Latin letters with up to one mark after them: one group for the model, or two."""
        tail = word[-1] if word[-1] in self.TAIL else ""
        core = word[:-1] if tail else word
        if not core.isalpha():
            return None
        if not core.isascii():
            if max(core) >= "\u0250" or "\u0130" in core:  # may lower or compose by context
                return None
            core = core.lower().encode().decode("latin-1").translate(self.BYTES)
        else:
            core = core.lower()
        ids = [x.id for x in self.model.tokenize(core)]
        return ids + self.tail[tail] if tail else ids

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found: list[list[int] | np.ndarray] = [self._letters(w) for w in words]
        others = [k for k, x in enumerate(found) if x is None]
        plain = [k for k in others if "<|" not in words[k]]
        for at in range(0, len(plain), 2048):
            part = plain[at : at + 2048]
            ids = np.asarray(self.tokenizer.encode(self.MARKS[1].join(words[k] for k in part), add_special_tokens=False).ids, np.int64)
            for k, x in zip(part, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                found[k] = x[1:] if k != part[0] else x
        for k in set(others) - set(plain):
            found[k] = self.tokenizer.encode(words[k], add_special_tokens=False).ids
        n = self.known.size
        if n + len(keys) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(n + len(keys) + len(self.first), np.int64)])
        ends = self.first[n] + np.cumsum([len(x) for x in found])
        if len(keys) and ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(int(ends[-1]) + len(self.ids), self.ids.dtype)])
        if len(keys):
            self.ids[self.first[n] : ends[-1]] = np.fromiter(chain.from_iterable(found), np.int64, int(ends[-1] - self.first[n]))
            self.first[n + 1 : n + 1 + len(keys)] = ends
        self.known.add(keys)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and where each document starts."""
        starts, ends, first = texts.split()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(texts.n + 1, np.int64)
        keys = texts.hashes(starts, ends)
        if self.known.size > CACHED_WORDS:
            self.clear()
        slot = self.known.find(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_index=True)
            raw = texts.data.tobytes()
            self._learn(distinct, [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new[at]].tolist(), ends[new[at]].tolist(), strict=True)])
            slot[new] = self.known.find(keys[new])
        begin, size = self.first[slot], self.first[slot + 1] - self.first[slot]
        past = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(past[-1]) + np.repeat(begin - past[:-1], size)
        return self.ids[source].astype(np.uint32), past[first]


class RoomTree:
    """Open windows by remaining capacity; finds the least capacity >= a size."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(self.base)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        k = room + self.base
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room >= size."""
        k = size + self.base
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.base
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, self.windows[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each size (1 to capacity), and the number of windows.

    Equal sizes keep their order; of windows with equal room the last that got
    this room is taken.
    """
    tree, window, offset, n = RoomTree(capacity), [0] * len(sizes), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[k])
        if not found:
            found, n = (capacity, n), n + 1
        room, window[k] = found
        offset[k] = capacity - room
        if room > sizes[k]:
            tree.add(room - sizes[k], window[k])
    return window, offset, n


_tokenizers: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their places in sequences of ``capacity`` tokens.

    Per piece: doc_id, start (its document's ids before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id
    and offset (gapless from 0 in its sequence).  A null or empty text is its
    end id alone; repeated rows are packed each; a null key stays null; other
    columns are ignored; an empty table gives no pieces.  Sequence ids are
    unique over all tasks.  Equal remainders are placed in the order in which
    a task reads them, so a task that runs again gives the same sequences if
    it reads the same rows in the same order, as it does from files; from
    other sources write ``docs`` first.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = WordTokenizer(shared.value)
        words = _tokenizers[tokenizer]
        next_id = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], list(names))

        def placed() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            window, offset, n = best_fit_decreasing([r[2] for r in rest], capacity)
            for at in range(0, len(rest), 4096):
                yield table([(*rest[k], next_id + window[k], offset[k]) for k in range(at, min(at + 4096, len(rest)))])
            next_id += n
            rest.clear()

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, to, texts in slices(batch.column(1)):
                ids, first = words.encode(texts)
                n = np.diff(first)
                whole = np.empty(len(ids) + texts.n, np.uint32)
                ends = np.cumsum(n + 1) - 1
                body = np.ones(len(whole), bool)
                body[ends] = False
                whole[ends], whole[body] = end_id, ids
                raw, full = whole.tobytes(), []
                for k, (doc, last) in enumerate(zip(keys[at:to], ends.tolist(), strict=True)):
                    tokens = int(n[k]) + 1
                    begin = last + 1 - tokens
                    for s in range(0, tokens - tokens % capacity, capacity):
                        full.append((doc, s, capacity, raw[4 * (begin + s) : 4 * (begin + s + capacity)], tokens, next_id, 0))
                        next_id += 1
                    if left := tokens % capacity:
                        rest.append((doc, tokens - left, left, raw[4 * (last + 1 - left) : 4 * (last + 1)], tokens))
                for s in range(0, len(full), 4096):
                    yield table(full[s : s + 4096])
                if len(rest) >= FLUSH:
                    yield from placed()
        if rest:
            yield from placed()

    return docs.select(docs[key].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
