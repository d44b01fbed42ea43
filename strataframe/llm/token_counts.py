"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end
at each character; dynamic programming carries the best score and the number
of pieces of its path.  Ties follow the tokenizer: of equal scores the path
whose last piece starts first stays.  Characters without a piece cost the least
score less 10 and count one token for each UTF-8 byte (byte fallback).  Texts
fall into segments at spaces, and segments seen before are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import bounded_batches, ship_package
from strataframe.llm._text import HashIndex, Texts, segment_sums, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers at most; then it starts anew.
CACHED = 1_500_000


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    """Best score and token count of segments and whole texts."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        scores = dict(vocabulary)
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("pieces must not reach over a space")
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex(np.zeros(0, np.uint64))
        self.score, self.count = np.zeros(1 << 12), np.zeros(1 << 12, np.int64)

    def segment(self, text: str) -> tuple[float, int]:
        n = len(text)
        best, count, lost = [0.0] * (n + 1), [0] * (n + 1), -float("inf")
        for e in range(1, n + 1):
            best[e] = lost
        done = 0
        for last, (length, score) in self.automaton.iter(text):  # by end; longest, so earliest start, first
            end = last + 1
            while done < last:
                self._unknown(text, best, count, done)
                done += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - length] + 1
        while done < n:
            self._unknown(text, best, count, done)
            done += 1
        return best[n], count[n]

    def _unknown(self, text: str, best: list[float], count: list[int], at: int) -> None:
        c = text[at]
        if c not in self.single and best[at] + self.unknown > best[at + 1]:
            best[at + 1], count[at + 1] = best[at] + self.unknown, count[at] + len(c.encode("utf-8", "surrogatepass"))

    def texts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Best score and token count of each text."""
        raw = texts.data.tobytes()
        if MARK.encode() in raw:  # a literal mark is a space to the tokenizer
            parts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)]
            raw = b"".join(parts)
            texts = Texts(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]))
        data, offsets = texts.data, texts.offsets
        space = np.flatnonzero(data == 32)
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        heads = heads[data[heads] != 32]
        # A segment is what follows its space (or the start of its text).
        starts = np.sort(np.concatenate([space + 1, heads]))
        doc = np.searchsorted(offsets, np.sort(np.concatenate([space, heads])), "right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), offsets[doc + 1])
        next_space = np.zeros(len(data) + 1, bool)
        next_space[space] = True
        ends = ends - ((ends > starts) & next_space[np.maximum(ends - 1, 0)])
        ends = np.maximum(ends, starts)
        keys = texts.hashes(starts, ends)
        if self.index.size > CACHED:
            self.clear()
        slot = self.index.find(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            distinct, at = np.unique(keys[new], return_index=True)
            found = [self.segment(MARK + raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[new[at]].tolist(), ends[new[at]].tolist(), strict=True)]
            n, to = self.index.size, self.index.size + len(found)
            if to > len(self.score):
                self.score, self.count = (np.concatenate([x, np.zeros(2 * to, x.dtype)]) for x in (self.score, self.count))
            self.score[n:to], self.count[n:to] = zip(*found, strict=True)
            self.index.add(distinct)
            slot[new] = self.index.find(keys[new])
        first = np.searchsorted(doc, np.arange(texts.n + 1))
        return segment_sums(self.score[slot], first), segment_sums(self.count[slot], first)


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """Per document: doc_id, n_tokens and the best path's score.

    Null and empty texts have no tokens.  Repeated rows each get a row, null
    ids stay null, other columns are ignored; an empty table gives an empty
    result.  The vocabulary is a fixed, public one and broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    name = hash(tuple(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(shared.value)
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                score, count = _counters[name].texts(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array(count), pa.array(score)], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, score double")
