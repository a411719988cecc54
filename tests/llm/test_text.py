import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import _segments as G
from newsloom.llm import _stats as S
from newsloom.llm._text import TextBlock, blocks, windows

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tÉé!#\x0b\x1c ", max_size=40)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_kernels_equal_regex(texts):
    b = TextBlock(pa.array(texts, pa.string()))
    words = [WORD.findall(t or "") for t in texts]
    assert b.n_words.tolist() == [len(w) for w in words]
    assert S.word_chars(b).tolist() == [sum(map(len, w)) for w in words]
    assert S.n_symbols(b).tolist() == [(t or "").count("#") for t in texts]
    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for t in texts]
    n, dup = b.dup_lines()
    assert n.tolist() == [len(x) for x in lines] and dup.tolist() == [len(x) - len(set(x)) for x in lines]
    flat = [w for ws in words for w in ws]
    same = {}
    for w, h in zip(flat, b.words.tolist(), strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    for k in (1, 2, 3):
        want = []
        for ws in words:
            seen = {}
            for i in range(len(ws) - k + 1):
                seen.setdefault(tuple(ws[i : i + k]), []).append(i)
            want.append(len({i + j for v in seen.values() if len(v) > 1 for i in v for j in range(k)}))
        assert b.repeated(k).tolist() == want
    distinct, top = S.word_spread(b)
    assert distinct.tolist() == [len(set(w)) for w in words]
    assert top.tolist() == [max(map(w.count, w), default=0) for w in words]


def test_lower_and_slices():
    column = pa.array(["x", "A É b", None, "a é B"]).slice(1)
    b = TextBlock(column, lower=True)
    assert b.n == 3 and b.words[0] == b.words[3] and b.words[1] != b.words[4]
    assert b.slice_bytes(0) == "a É b".encode()
    assert [list(r) for r in blocks(pa.array(["aaa", "bb", None, "c" * 9, "d"]), 4)] == [[0, 1], [1, 3], [3, 4], [4, 5]]


@pytest.mark.parametrize("k", [1, 2, 5, 8, 35])
def test_windows(k):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 3, 400).astype(np.uint64)
    got = windows(h, k)
    seen = {}
    for i in range(len(h) - k + 1):
        assert seen.setdefault(tuple(h[i : i + k]), got[i]) == got[i]
    assert len(set(map(int, seen.values()))) == len(seen) and len(got) == len(h) - k + 1


def test_exchange_helpers():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    for n in (1, 7, 1 << 20):
        which, place = G.range_of(h, n)
        assert which.tolist() == [int(x) * n >> 64 for x in h] and place.tolist() == [int(x) * n & (1 << 64) - 1 for x in h]
    counts = rng.integers(0, 1 << 33, len(h))
    for bits in (64, 50, 32):
        for c, check in ((counts, None), (np.ones(len(h), np.int64), h.astype(np.uint32))):
            place, got, seen = G.decode(G.encode(h, c, check, bits))
            assert (place == h >> np.uint64(64 - bits) << np.uint64(64 - bits)).all() and (got == c).all()
            assert check is None or (seen == check).all()
    assert (G.unpacked([G.packed(counts[:5].astype(np.uint64)), G.packed(counts[5:].astype(np.uint64))], np.uint64) == counts.astype(np.uint64)).all()
    order = G.ascending(np.concatenate([h[::-1], h]))
    assert (np.concatenate([h[::-1], h])[order] == np.repeat(h, 2)).all() and (order[1::2] > order[::2]).all()
    close = np.arange(5000, dtype=np.uint64)[::-1].copy()  # leading bits alone cannot order these
    assert (close[G.ascending(close)] == np.arange(5000)).all()


def test_exchange_rows_stay_linear():
    for tb in (1e-4, 5e-4, 1, 100):
        segments, keys = max(1, int(tb * 1e12 / (4 << 20))), int(tb * 1e12 / 6)
        r, senders, done = G.Ranges.of(keys, segments), segments, 1
        for split in r.splits:
            assert senders * done * (split if done > 1 else r.first) <= 2 * 512 * segments + 512 * 512
            senders, done = -(-senders // G.FAN), done * split
        assert r.total * G.RANGE_KEYS >= keys
