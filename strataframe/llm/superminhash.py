"""SuperMinHash signatures, computed for many documents at once.

Round j draws the j-th entry of every element's own permutation of the slots
(a Fisher-Yates step) and offers ``j + u`` to that slot of the element's
document, u uniform in [0, 1).  Offers of later rounds are larger, so a
document stops as soon as all its slots hold something: about
``slots * ln(slots) / n`` rounds for n elements instead of ``slots`` hashes per
element, and as ranks are drawn without replacement, estimates vary less.
"""

from __future__ import annotations

import numpy as np

from strataframe.llm._text import mix

#: Elements whose permutations are held at once (each takes ``slots`` bytes).
CHUNK = 1 << 16
_STEP = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(2**64 - 1)


def signatures(elements: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """uint64 (documents, slots); rows without elements hold the largest value.

    ``elements`` are 64-bit keys, those of document d at first[d]:first[d+1].
    A value holds the rank in its top byte and the fraction below.
    """
    if not 1 < slots <= 256:
        raise ValueError("2 to 256 slots")
    out = np.full((len(first) - 1, slots), _EMPTY)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    at = 0
    while at < len(order):
        room = np.searchsorted(np.cumsum(size[order[at:]]), CHUNK, "right")
        part = order[at : at + max(1, int(room))]
        out[part] = _chunk(elements, first, part, slots)
        at += len(part)
    return out


def _chunk(elements: np.ndarray, first: np.ndarray, docs: np.ndarray, slots: int) -> np.ndarray:
    if len(docs) == 1 and first[docs[0] + 1] - first[docs[0]] > CHUNK:  # a very long document, in parts
        d = docs[0]
        cuts = np.append(np.arange(first[d], first[d + 1], CHUNK), first[d + 1])
        return np.min([_chunk(elements, cuts, np.array([k]), slots) for k in range(len(cuts) - 1)], axis=0)
    size = first[docs + 1] - first[docs]
    begin = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    keys = elements[np.arange(len(begin)) + begin]
    doc = np.repeat(np.arange(len(docs)), size)
    left = np.tile(np.arange(slots, dtype=np.uint8), (len(keys), 1))
    row = np.arange(len(keys))
    best = np.full((len(docs), slots), _EMPTY)
    flat = best.reshape(-1)
    for j in range(slots):
        draw = mix(keys + np.uint64(_STEP * (j + 1) % 2**64))
        pick = j + (((draw >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        slot = left[row, pick]
        left[row, pick] = left[row, j]
        value = (np.uint64(j) << np.uint64(56)) | (mix(draw) >> np.uint64(8))
        np.minimum.at(flat, doc * slots + slot, value)
        done = best.max(axis=1) < np.uint64((j + 1) << 56) if j < 255 else np.ones(len(docs), bool)
        if done.any():
            stay = ~done[doc]
            if not stay.any():
                break
            keys, doc, row = keys[stay], doc[stay], row[stay]
    return best


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    """int64 (documents, slots // rows): a key for each band of ``rows`` values."""
    docs, slots = sigs.shape
    bands = slots // rows
    values = sigs[:, : bands * rows].reshape(docs, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(_STEP), (docs, bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93 | 1) + values[:, :, k])
    return key.view(np.int64)
