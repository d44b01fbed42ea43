"""Array kernels against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strataframe.llm import _blobs, decontamination, packing, sharding, substring_dedup, suffix_tree_lm, superminhash, token_counts
from strataframe.llm._text import HashIndex, slices
from strataframe.llm.quality_classifier import messages
from strataframe.llm.suffix_array import permuted_prefixes, suffix_array

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "abcXYZ éÉßÑİŉªº.,!'\"-|<>0129½Σσς̸́\xa0 日本\x1c\x85\t\n é▁ꙮ"


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [None, "", " ", "\n", "<|endoftext|> a<|startoftext|>b", "it's I'LL", "<s> a</s> <0x0A>"]


def test_words_and_hashes():
    texts = odd_texts(300)
    seen = {}
    for at, to, part in slices(pa.array(texts), 256):
        starts, ends, first = part.split()
        keys = part.hashes(starts, ends)
        for k in range(at, to):
            a, b = first[k - at], first[k - at + 1]
            words = [part.data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
            assert words == WORDS.findall(texts[k] or "")
            for w, h in zip(words, keys[a:b].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hash_index():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    index = HashIndex(keys[:10])
    index.add(keys[10:4000])
    found = index.find(keys)
    assert (found[:4000] == np.arange(4000)).all() and (found[4000:] == -1).all()


def test_superminhash_is_unbiased_and_finer_than_independent_hashes():
    rng = np.random.default_rng(1)
    for n in (5, 40, 300):
        got = []
        for _ in range(400):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = a.copy()
            b[: n // 4] = rng.integers(0, 2**63, n // 4, dtype=np.uint64)
            s = superminhash.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]), 128)
            got.append((s[0] == s[1]).mean())
        j = (n - n // 4) / (n + n // 4)
        assert abs(np.mean(got) - j) < 0.01
        assert np.std(got) < 1.05 * (j * (1 - j) / 128) ** 0.5


def test_superminhash_of_long_sets_in_parts():
    keys = np.random.default_rng(2).integers(0, 2**63, superminhash.CHUNK * 2 + 7, dtype=np.uint64)
    whole = superminhash.signatures(keys, np.array([0, len(keys)]), 64)
    shuffled = superminhash.signatures(keys[::-1].copy(), np.array([0, len(keys)]), 64)
    assert (whole == shuffled).all()


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for t in range(600):
        d = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)
        d = np.tile(d, 3) if t % 3 == 0 else d
        s = d.tobytes()
        sa = suffix_array(d)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        phi, prefix = permuted_prefixes(d, sa, 10**9)
        for a, b in zip(sa.tolist(), sa.tolist()[1:], strict=False):
            k = 0
            while a + k < len(s) and b + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert phi[b] == a and prefix[b] == k


def test_pieces_cover_each_window_once_and_follow_content():
    rng = random.Random(5)
    common = "".join(rng.choice("ab ") for _ in range(500))
    texts = ["x" * 30 + common, common, "a" * 700, "", "short", common + common]
    names = {}
    for at, to, part in slices(pa.array(texts), 1500):
        doc, first, count, distance, name = substring_dedup.named_pieces(part, 200, 40)
        for k in range(at, to):
            mine = doc == k - at
            windows = np.concatenate([np.arange(f, f + c) for f, c in zip(first[mine], count[mine], strict=True)] or [np.zeros(0, int)])
            assert sorted(windows.tolist()) == list(range(max(0, len(texts[k]) - 199)))
            for f, c, d, h in zip(first[mine], count[mine], distance[mine], name[mine], strict=True):
                for i in range(c):
                    key = texts[k][f + i : f + i + 200]
                    assert names.setdefault(key, (h, d - i)) == (h, d - i)


def test_best_fit_decreasing():
    rng = random.Random(0)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        window, offset, n = packing.best_fit_decreasing(sizes, 32)
        room, want = [], {}
        for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):  # the plain way
            fits = [r for r in room if r >= sizes[k]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - sizes[k])
            else:
                room.append(32 - sizes[k])
            want[k] = sorted(room)
        used = {}
        for k in range(len(sizes)):
            used.setdefault(window[k], []).append((offset[k], sizes[k]))
        assert len(used) == n == len(room)
        assert sorted(32 - sum(s for _, s in x) for x in used.values()) == sorted(room)
        for x in used.values():
            at = 0
            for o, s in sorted(x):
                assert o == at
                at += s


def test_word_tokenizer_equals_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = packing.WordTokenizer(open(path, encoding="utf-8").read())
    texts = odd_texts(3000)
    for at, to, part in slices(pa.array(texts), 1 << 14):
        ids, first = words.encode(part)
        for k in range(at, to):
            assert words.tokenizer.encode(texts[k] or "", add_special_tokens=False).ids == ids[first[k - at] : first[k - at + 1]].tolist()


def test_token_counts_equal_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = odd_texts(2000, 3) + ["two  spaces ", " lead", "▁mark ▁▁"]
    counter = token_counts.Counter(vocabulary)
    for at, to, part in slices(pa.array(texts), 1 << 14):
        _, count = counter.texts(part)
        assert count.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts[at:to]]


def test_token_count_ties_keep_the_earliest_start():
    counter = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0)])
    assert counter.segment("▁aa") == (-3.0, 2)


def test_lookup_table_by_hand():
    names, size = [f"s{k}" for k in range(5)], 101
    table = sharding.lookup_table(names, size)
    import hashlib

    def preference(name):
        d = hashlib.md5(name.encode()).digest()
        return [(int.from_bytes(d[:8], "little") + j * (int.from_bytes(d[8:], "little") % (size - 1) + 1)) % size for j in range(size)]

    want, turn, lists = {}, 0, [preference(n) for n in names]
    while len(want) < size:
        slot = next(s for s in lists[turn % 5] if s not in want)
        want[slot] = turn % 5
        turn += 1
    assert table.tolist() == [want[k] for k in range(size)]
    fewer = sharding.lookup_table(names[:4], size)
    assert (table[table < 4] == fewer[table < 4]).mean() > 0.6
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(4)
    first = np.array([0, 1, 4, 9])
    odds, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    ahead, back = messages(odds, trans, first)
    for a, b in zip(first, first[1:], strict=False):
        n = b - a
        weight = np.zeros((n, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(odds[a + k] for k in range(n) if y[k]) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            for k in range(n):
                weight[k, y[k]] += w
        assert np.allclose(np.log(weight[:, 1] / weight[:, 0]), (ahead + back)[a:b])


@pytest.mark.parametrize("n", [70, 700])
def test_block_max_retrieval_equals_full_scoring(n):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for k in range(n)]
    index = decontamination.build_index(items).open()
    texts = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(6)] + ["", items[3][1], " ".join(rng.choices(vocabulary, k=50)) + " " + items[9][1] + " end"]
    (at, to, part), = slices(pa.array(texts))
    starts, ends, first = part.split(decontamination.PUNCTUATION)
    words = part.hashes(starts, ends, lower=True)
    ids = index.find(words)
    got = {(d, w, i): s for d, w, i, s in zip(*(x.tolist() for x in decontamination.retrieve(index, ids, first)), strict=True)}
    # BM25 by the textbook, item by item.
    bags = [t.split() for _, t in items]
    mean = sum(map(len, bags)) / n
    df = Counter(w for b in bags for w in set(b))
    impact = [{w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w, c in Counter(b).items()} for b in bags]
    want, step = {}, (index.window + 1) // 2
    for d, t in enumerate(texts):
        own = t.split()
        for w in range(max(1, -(-len(own) // step) - 1) if own else 0):
            inside = set(own[w * step : w * step + 2 * step])
            for i, x in enumerate(impact):
                score = sum(v for k, v in x.items() if k in inside)
                if score >= 0.5 * sum(x.values()) * (1 - 1e-6):
                    want[d, w, i] = score
    number = {int(i): k for k, i in enumerate(index.items)}
    assert set(got) == {(d, w, number[i]) for d, w, i in want}
    assert all(abs(got[d, w, number[i]] - s) < 1e-9 for (d, w, i), s in want.items())
    assert any(d == 7 for d, _, _ in got) and any(d == 8 for d, _, _ in got)
    assert len(index.levels) > 2


def test_neighbours_send_what_is_before_them_once():
    """Runs come back as they were, at the tokens' own size; least runs are those of plain search."""
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    runs = suffix_tree_lm.Runs(words=words, first=np.array([0, 1000, 3000]))
    for length, gram in ((3, 3), (7, 4), (19, 10), (20, 1)):
        at = np.flatnonzero(runs.room >= length)
        want = [min(int(runs.key(np.array([k]), gram)[0]) for k in range(p - length, p - gram + 1)) for p in at[::97]]
        assert runs.least(at, length, gram)[::97].tolist() == want
    start, length = np.array([5, 1200, 40]), np.array([300, 80, 7])
    batch = _blobs.pack_runs(np.array([1, 0, 1]), length, np.array([9, 8, 7]), np.array([1, 5, 2]), start, words)
    assert sum(len(x) for x in batch.column(2).to_pylist()) == 8 * length.sum() + 12 * 3 + 16 * 2
    got_length, lead, n, got = _blobs.unpack_runs(_blobs.gather([batch])[0])
    assert (got_length.tolist(), lead.tolist(), n.tolist()) == ([80, 300, 7], [8, 9, 7], [5, 1, 2])
    assert (got == np.concatenate([words[1200:1280], words[5:305], words[40:47]])).all()


def test_a_question_takes_ten_bytes():
    keys, rows = np.arange(900, dtype=np.uint64) << np.uint64(40), (np.arange(900) * 71) + (5 << 40)
    batch = _blobs.pack_asked(np.arange(900) % 3, keys, rows, 5 << 40, 0)
    assert sum(len(x) for x in batch.column(2).to_pylist()) == 10 * 900 + 16 * 3
    got = _blobs.unpack_asked(_blobs.gather([batch])[0])
    assert sorted(zip(got[0].tolist(), got[1].tolist(), strict=True)) == list(zip(keys.tolist(), rows.tolist(), strict=True))


def test_frequent_words_go_as_short_numbers():
    """Codes, runs and questions come back as they were, and take fewer bytes than keys."""
    rng = np.random.default_rng(6)
    frequent = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    words = np.where(rng.random(3000) < 0.9, frequent[rng.integers(0, len(frequent), 3000)], rng.integers(0, 2**63, 3000, dtype=np.uint64))
    codes, n = np.unique(rng.integers(0, 2**36, 500, dtype=np.uint64)), np.where(np.arange(500) % 3, 1, 70000)
    batch = _blobs.pack_codes(codes % np.uint64(4), codes, n[: len(codes)], 5, 1)
    got, times = _blobs.unpack_codes(_blobs.gather([batch])[1], 5)
    assert dict(zip(got.tolist(), times.tolist(), strict=True)) == dict(zip(codes.tolist(), n.tolist(), strict=False))
    start, length = np.array([5, 1200]), np.array([300, 80])
    batch = _blobs.pack_runs(np.array([1, 0]), length, np.array([9, 8]), np.array([1, 5]), start, words, known=HashIndex(frequent))
    assert sum(len(x) for x in batch.column(2).to_pylist()) < 5 * length.sum()
    assert (_blobs.unpack_runs(_blobs.gather([batch])[0], frequent)[3] == np.concatenate([words[1200:1280], words[5:305]])).all()
    rows = np.sort(rng.integers(0, 60000, 500)) + (3 << 40)
    batch = _blobs.pack_asked(np.arange(len(codes)) % 3, codes, rows[: len(codes)], 3 << 40, 0, 5)
    got = _blobs.unpack_asked(_blobs.gather([batch])[0], 5)
    assert sorted(zip(got[1].tolist(), got[0].tolist(), strict=True)) == sorted(zip(rows.tolist(), codes.tolist(), strict=False))


def test_a_run_is_asked_for_once():
    """The pair of a context and a token, and the longer context that they are, make one question."""
    rng = np.random.default_rng(7)
    runs = suffix_tree_lm.Runs(words=rng.integers(0, 9, 600, dtype=np.uint64) + np.uint64(1), first=np.array([0, 200, 600]))
    all_ = lambda keys: np.ones(len(keys), bool)
    short = lambda keys: keys % np.uint64(3) > 0
    for tried in (all_, short):
        contexts = list(itertools.islice(suffix_tree_lm.context_keys(runs, tried, all_), 5))
        want = {(d, e) for d, (here, _, _) in enumerate(contexts, 1) for e in (here - 1).tolist()} | {(d + 1, e) for d, (here, _, _) in enumerate(contexts, 1) for e in here.tolist()}
        got = [(d, int(e), int(k)) for d, (end, key) in enumerate(suffix_tree_lm.scored_runs(runs, contexts), 1) for e, k in zip(end, key, strict=True)]
        assert len(got) == len(want) and {x[:2] for x in got} == want
        assert all(k == int(runs.key(np.array([e - d + 1]), d)[0]) for d, e, k in got)
