"""Suffix arrays by induced sorting and permuted common prefixes.

Suffixes are classified as larger (L) or smaller (S) than their successor; the
leftmost S suffixes (LMS) are sorted by inducing their substrings, naming them
and sorting the string of names in the same way, and all others are induced
from them.  On bytes the two scans of induced sorting go bucket by bucket, each
bucket in waves, so every step handles whole arrays; on strings of names, whose
alphabets are large, they go element by element.
"""

from __future__ import annotations

import numpy as np

_END = 257


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last character is a unique least sentinel."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = np.append(text[:-1] < text[1:], True)
    return small[following]


def _place(sa: np.ndarray, free: np.ndarray, chars: np.ndarray, values: np.ndarray, step: int) -> None:
    """Append ``values`` in order to their characters' buckets; ``free`` moves by ``step``."""
    order = np.argsort(chars, kind="stable")
    c = chars[order].astype(np.int64)
    size = np.bincount(c, minlength=_END)
    begin = np.cumsum(size) - size
    sa[free[c] + step * (np.arange(len(c)) - begin[c])] = values[order]
    free += step * size


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the LMS ones in the given order."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(text, minlength=_END)
    end = np.cumsum(size)
    begin = end - size
    chars = text[lms]
    by = np.argsort(chars, kind="stable")
    grouped, edge = lms[by], np.searchsorted(chars[by], np.arange(_END + 1))
    head = begin.copy()
    present = np.flatnonzero(size)
    for c in present:
        done = begin[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            p = wave[wave > 0] - 1
            p = p[~small[p]]
            _place(sa, head, text[p], p, 1)
        p = grouped[edge[c] : edge[c + 1]] - 1
        p = p[p >= 0]
        _place(sa, head, text[p], p, 1)
    tail = end - 1
    sa[tail[0]] = n - 1
    tail[0] -= 1
    for c in present[::-1]:
        done = end[c] - 1
        while done > tail[c]:
            wave = sa[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            p = wave[wave > 0] - 1
            p = p[small[p]]
            _place(sa, tail, text[p], p, -1)
        larger = sa[begin[c] : head[c]][::-1]
        p = larger[larger > 0] - 1
        p = p[small[p]]
        _place(sa, tail, text[p], p, -1)
    return sa


def _induce_names(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for any alphabet, an element at a time."""
    n, size = len(text), np.bincount(text)
    end = np.cumsum(size)
    # The bucket into which a suffix puts the one before it, -1 for none; the last entry is for places without a suffix.
    ahead, back = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    ahead[1:n] = np.where(small[:-1], -1, text[:-1])
    back[1:n] = np.where(small[:-1], text[:-1], -1)
    into, sa = ahead.tolist(), np.full(n, -1, np.int64)
    chars = text[lms]
    by = np.argsort(chars, kind="stable")
    held = np.bincount(chars, minlength=len(size))
    first = np.cumsum(held) - held
    c = chars[by]
    sa[end[c] - held[c] + np.arange(len(by)) - first[c]] = lms[by]  # at the ends of their buckets, in order
    sa = sa.tolist()
    head = (end - size).tolist()
    for i in sa:  # sees what it puts ahead of itself
        c = into[i]
        if c >= 0:
            sa[head[c]] = i - 1
            head[c] += 1
    into, tail = back.tolist(), (end - 1).tolist()
    for at in range(n - 1, -1, -1):
        i = sa[at]
        c = into[i]
        if c >= 0:
            sa[tail[c]] = i - 1
            tail[c] -= 1
    return np.array(sa, np.int64)


def _sort(text: np.ndarray, induce) -> np.ndarray:
    """Suffix array of a string whose last character is its unique least one."""
    n = len(text)
    small = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = induce(text, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    length = np.diff(np.append(lms, n))[number[ordered]]  # up to the next LMS suffix
    same = np.zeros(len(ordered), bool)
    pairs = np.flatnonzero(length[1:] == length[:-1]) + 1
    k = 0
    while len(pairs):  # the next LMS character belongs to the substring
        a, b = ordered[pairs] + k, ordered[pairs - 1] + k
        inside = (a < n) & (b < n)
        pairs, a, b = pairs[inside], a[inside], b[inside]
        pairs = pairs[text[a] == text[b]]
        k += 1
        whole = length[pairs] < k
        same[pairs[whole]] = True
        pairs = pairs[~whole]
    names = np.cumsum(~same) - 1
    if len(names) and names[-1] < len(names) - 1:
        in_text = np.empty(len(lms), np.int64)
        in_text[number[ordered]] = names
        # A comparison ends at the first name that is there once, so names once each after another of that kind are left out.
        again = np.bincount(in_text)[in_text] > 1
        used = again.copy()
        used[1:] |= again[:-1]
        used[-1] = True  # the last name is the sentinel's, the least
        rank = np.zeros(len(lms), np.int64)
        rank[np.flatnonzero(used)[_sort(in_text[used], _induce_names)]] = np.arange(used.sum())
        ordered = lms[np.lexsort((rank, in_text))]
    return induce(text, small, ordered)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of the bytes in order."""
    text = np.zeros(len(data) + 1, np.uint16)
    text[:-1] = data
    text[:-1] += 1
    return _sort(text, _induce)[1:]


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position its predecessor in the array (-1: none) and their common prefix.

    Only positions whose prefix isn't implied by the one before are compared,
    up to ``cap`` bytes; the others follow by subtracting one.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    implied = np.zeros(n, bool)
    if n > 1:
        implied[1:] = (phi[1:] > 0) & (data[:-1] == data[phi[1:] - 1])
    start = np.flatnonzero(~implied & (phi >= 0))
    common = np.zeros(n, np.int64)
    live, k = start, 0
    while len(live) and k < cap:
        a, b = live + k, phi[live] + k
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[data[a] == data[b]]
        k += 1
        common[live] = k
    origin = np.maximum.accumulate(np.where(implied, -1, at))
    prefix = np.maximum(common[origin] - (at - origin), 0)
    prefix[phi < 0] = 0
    return phi, prefix
