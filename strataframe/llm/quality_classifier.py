"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is good or bad.  Its label depends on its own features,
on those of the lines before and after it and on its neighbours' labels.
Forward-backward marginals, weighted by line length, make the document's score.
Training takes a bounded sample of labelled documents whose lines all carry
the document's label, and runs on the driver; scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm._spark import bounded_batches, ship_package
from strataframe.llm._text import LOWER, Texts, segment_sums, slices

#: Labelled documents that training takes at most, and lines of one of them.
SAMPLE_DOCS, SAMPLE_LINES = 3000, 400
STEPS, RATE, PENALTY = 200, 0.1, 2e-3
ACCEPT = 0.3

#: Byte classes that lines are described by.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>@^~=_", b"!?", b"0123456789", b".", b",;:", b"|"]
_CLASS = np.zeros((256, len(CLASSES)), bool)
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c), _k] = True
#: Feature -> values above which a further indicator is set.
CUTS = {0: (0.35, 0.7), 1: (0.35, 0.8), 2: (0.1, 0.3, 0.5), 3: (0.02, 0.1, 0.3), 4: (0.02, 0.1, 0.5), 5: (0.05, 0.2), 6: (0.02, 0.1, 0.4), 7: (0.1, 0.3, 0.6), 9: (0.02, 0.3), 11: (0.3, 0.7), 12: (0.01, 0.1, 0.3)}
RAW = 14


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw features (lines x RAW) of lines with a word, their bytes, and first lines per document.

    A document without words is one empty line.
    """
    starts, ends, _ = texts.split()
    data, n = texts.data, texts.n
    cuts = np.unique(np.concatenate([texts.offsets[:-1], np.flatnonzero(data == 10) + 1, [len(data)]]))
    line_of = np.searchsorted(cuts, starts, "right") - 1
    used, word_line = np.unique(line_of, return_inverse=True)
    a, b = cuts[used], cuts[np.minimum(used + 1, len(cuts) - 1)]
    doc = np.searchsorted(texts.offsets, a, "right") - 1
    words = np.bincount(word_line, minlength=len(used)).astype(float)
    first_word = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    size = np.maximum(segment_sums(ends - starts, first_word), 1).astype(float)
    keys = texts.hashes(starts, ends)
    same = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        same[1:] = (keys[1:] == keys[:-1]) & (word_line[1:] == word_line[:-1])
    order = np.lexsort((keys, word_line))
    new = np.ones(len(keys), np.int64)
    if len(keys) > 1:
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (word_line[1:] != word_line[:-1])
    counts = np.zeros((len(used), len(CLASSES)))
    for k in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(_CLASS[data, k], dtype=np.int64)])
        counts[:, k] = sums[b] - sums[a]
    capital = (LOWER[data[starts]] != data[starts]).astype(np.int64)
    whole = texts.hashes(a, b)
    by = np.lexsort((np.arange(len(whole)), whole, doc))
    again = np.zeros(len(whole))
    if len(whole) > 1:
        again[by[1:]] = (whole[by][1:] == whole[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    last_word = ends[first_word[1:] - 1] - 1 if len(used) else np.zeros(0, np.int64)
    found = np.stack(
        [
            np.log1p(words) / 6, size / words / 12, counts[:, 0] / size, counts[:, 1] / size, counts[:, 2] / words, counts[:, 3] / size,
            segment_sums(same, first_word) / words, 1 - segment_sums(new, first_word) / words, again, counts[:, 4] / words, counts[:, 5] / words,
            segment_sums(capital, first_word) / words, counts[:, 6] / words, np.isin(data[last_word], [33, 46, 63]).astype(float),
        ],
        axis=1,
    ) if len(used) else np.zeros((0, RAW))
    per_doc = np.bincount(doc, minlength=n) if len(used) else np.zeros(n, np.int64)
    lines = np.maximum(per_doc, 1)
    first = np.concatenate([[0], np.cumsum(lines)])
    out, length = np.zeros((first[-1], RAW), np.float32), np.ones(first[-1])
    at = np.arange(len(used)) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per_doc)[:-1]]), per_doc)
    out[at], length[at] = found, size
    return out, length, first


def expand(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All features: own, indicators, the neighbours', ends of the document, constant."""
    head, tail = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    before, after = np.zeros_like(raw), np.zeros_like(raw)
    before[1:], after[:-1] = raw[:-1], raw[1:]
    before[head], after[tail] = 0, 0
    cuts = [(raw[:, f] > x)[:, None] for f, values in CUTS.items() for x in values]
    return np.concatenate([raw, *cuts, before, after, head[:, None], tail[:, None], np.ones((len(raw), 1))], axis=1).astype(np.float32)


def messages(odds: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds (good against bad) that each line gets from itself and those before, and from those after.

    ``trans[a, b]`` is the score of label b after label a.  All documents move
    a line at a time, the long ones on by themselves.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    active = len(size) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), "right")
    ahead, back = odds.astype(float).copy(), np.zeros(len(odds))
    start, stop = first[:-1][order], first[1:][order] - 1
    (t00, t01), (t10, t11) = trans
    for t in range(1, len(active)):
        now = start[: active[t]] + t
        r = ahead[now - 1]
        ahead[now] += np.logaddexp(t01, t11 + r) - np.logaddexp(t00, t10 + r)
        now = stop[: active[t]] - t
        r = odds[now + 1] + back[now + 1]
        back[now] = np.logaddexp(t10, t11 + r) - np.logaddexp(t00, t01 + r)
    return ahead, back


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(raw: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores of greatest penalised likelihood (Adam, full batches).

    Without both labels in the sample the weights stay 0 but for the constant.
    """
    x = expand(raw, first)
    weights, trans = np.zeros(x.shape[1]), np.array([[0.5, -0.5], [-0.5, 0.5]])
    if not len(label):
        return weights, trans
    y = np.repeat(label, np.diff(first)).astype(float)
    weights[-1] = np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5))
    if label.min() == label.max():
        return weights, np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    left = np.flatnonzero(inner)
    params = np.concatenate([weights, trans.ravel()])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights, trans = params[:-4], params[-4:].reshape(2, 2)
        odds = x @ weights
        ahead, back = messages(odds, trans, first)
        p = sigmoid(ahead + back)
        joint = np.stack([np.full(len(left), trans[a, b]) + a * ahead[left] + b * (odds[left + 1] + back[left + 1]) for a in (0, 1) for b in (0, 1)])
        joint = np.exp(joint - joint.max(axis=0))
        joint = (joint / joint.sum(axis=0)).sum(axis=1)
        stay = y[left].sum()
        grad = np.concatenate([x.T @ (y - p), np.array([len(left) - stay, 0, 0, stay]) - joint]) / len(label) - PENALTY * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Fit on up to ``sample`` labelled documents outside the held-out fold, the first by a hash of their id.

    Of conflicting labels of a document the greatest counts, of rows that
    repeat an id one.
    """
    known = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != 0)
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("quality").cast("long").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("long").alias("d_id"), "text")
    found = own.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id"))
    # Of rows that repeat an id the one of the least hash counts, so as many texts at most are gathered as are asked for.
    texts = found.groupBy("l_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), F.col("text"))).alias("one")).select("one.text", "one.label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for at, _, part in slices(batch.column(0)):
                raw, _, first = line_features(part)
                rows = [(raw[a:b].tobytes(), labels[at + k]) for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b - a <= SAMPLE_LINES]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["raw", "label"])

    rows = sorted(tuple(r) for r in texts.mapInArrow(run, "raw binary, label bigint").collect())
    lines = [np.frombuffer(bytes(r[0]), np.float32).reshape(-1, RAW) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    return fit(np.concatenate([np.zeros((0, RAW), np.float32), *lines]), first, np.array([r[1] for r in rows], np.int64))


def text_scores(texts: Texts, weights: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of lines of each text."""
    raw, length, first = line_features(texts)
    ahead, back = messages(expand(raw, first) @ weights, trans, first)
    value = segment_sums(sigmoid(ahead + back) * length, first) / segment_sums(length, first)
    return np.clip(value, 0, 1), np.diff(first)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (score >= 0.3), n_lines.

    Only the text makes the score.  Null, empty and white texts are one empty
    line.  Repeated rows each get a row, a null doc_id counts as the empty text
    in the fold; other columns are ignored; an empty table gives an empty
    result; without labels the score is that of no evidence.
    """
    spark = docs.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    weights, trans = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in slices(batch.column(1)):
                value, lines = text_scores(texts, weights, trans)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array(value), pa.array(lines)], ["doc_id", "score", "n_lines"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double, n_lines bigint")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "n_lines")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score is below the bound.

    Each row is judged by its own text as it passes by: nothing is joined or
    shuffled, and a null or repeated doc_id makes no difference.
    """
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    weights, trans = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at, to, texts in slices(batch.column("text")):
                keep[at:to] = text_scores(texts, weights, trans)[0] >= ACCEPT
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
