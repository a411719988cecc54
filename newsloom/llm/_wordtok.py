"""Whole-text encoding with a ``tokenizers`` file, memoised by word.

A tokenizer that drops white space and lower-cases encodes each space-separated word
by itself, so a text's ids are the ids of its words in order; a full stop or comma
after a letter is a word of its own.  New words are encoded together in one call.  The
memo has two generations of bounded size.  A tokenizer that fails the probe for these
properties gets whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from newsloom.llm._shared import CACHES
from newsloom.llm._text import _LOWER, _SPACE, TextBlock

END_ID = 2
MEMO_WORDS = 500_000
_MARK = "\x01"
_CALL_WORDS = 1_500  # per call of the library; longer texts leave the processor's cache
_GATHER_WORDS = 1 << 16  # whose ids are put in place together; a text may have any number
_POINT = np.zeros(256, bool)
_POINT[list(b".,!?;:")] = True
_BLANK = bytes(np.flatnonzero(_SPACE).tolist())
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True


def split_words(b: TextBlock) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts with ASCII letters in lower case, a lone point or comma
    that ends a word being one of its own, and the number of words before each text
    (one more entry ends the last text)."""
    raw = b.data.tobytes().translate(_LOWER.tobytes())
    d = np.frombuffer(raw, np.uint8)
    space = ((d - np.uint8(9)) < 5) | (d == 32)
    first = np.zeros(len(d) + 1, bool)  # byte of a text; the last entry is no byte
    first[b.off] = True
    ends = first[1:].copy()
    ends[:-1] |= space[1:]
    point = np.flatnonzero(np.frombuffer(raw.translate(_POINT.tobytes()), bool))
    point = point[ends[point] & ~first[point]]
    point = point[_ALNUM[d[point - 1]]]
    heads = first[:-1]
    heads[1:] |= space[:-1]
    heads[point], ends[point - 1] = True, True
    solid = ~space
    heads, ends = np.flatnonzero(heads & solid), np.flatnonzero(ends & solid)
    off = np.zeros(len(heads) + 1, np.int64)
    np.cumsum(ends + 1 - heads, out=off[1:])  # words touch once the spaces are gone
    words = pa.Array.from_buffers(
        pa.large_binary(), len(heads),
        [None, pa.py_buffer(off), pa.py_buffer(raw.translate(None, _BLANK))]
    )
    return words, np.searchsorted(heads, b.off)


def listed(words: pa.Array) -> list[bytes]:
    """The values of a large binary array without an offset; ``to_pylist`` takes five times as long."""
    if not len(words):
        return []
    off = np.frombuffer(words.buffers()[1], np.int64, count=len(words) + 1).tolist()
    raw = words.buffers()[2].to_pybytes()
    return [raw[s:e] for s, e in zip(off[:-1], off[1:], strict=True)]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.limit = memo_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        one = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        mark = one(_MARK)
        self.mark = mark[0] if len(mark) == 1 else -1
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.by_word = self.mark >= 0 and one(f"Ab9,c\t{_MARK}\n d'é") == one("ab9,c") + mark + one("d'é") and one("Yes.") == one("yes") + one(".") and one("É") == one("é") and one(" ") == []

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)  # without offsets

    def _learn(self, words: list[bytes]) -> None:
        letters, plain = [], []
        for w in words:
            text = w.decode()
            if b"\x01" in w or b"<|" in w:
                self.young[w] = self._ids(text).tobytes()
            else:
                (letters if text.isalpha() else plain).append(w)
        size = self.dtype.itemsize
        for a in range(0, len(letters), _CALL_WORDS):  # a word of letters ends with the one token that closes a word
            part = letters[a : a + _CALL_WORDS]
            ids = self._ids(b" ".join(part).decode())
            cut = ((np.flatnonzero(self.closes[ids]) + 1) * size).tolist()
            if len(cut) != len(part):
                plain += part
                continue
            raw = ids.tobytes()
            self.young.update(zip(part, [raw[s:e] for s, e in zip([0, *cut[:-1]], cut, strict=True)], strict=True))
        for a in range(0, len(plain), _CALL_WORDS):
            part = plain[a : a + _CALL_WORDS]
            ids = self._ids(f" {_MARK} ".encode().join(part).decode())
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(part) - 1:  # some word has the marker's token
                for w in part:
                    self.young[w] = self._ids(w.decode()).tobytes()
                continue
            raw = ids.tobytes()
            starts, ends = [0, *((cut + 1) * size).tolist()], [*(cut * size).tolist(), len(raw)]
            self.young.update(zip(part, [raw[s:e] for s, e in zip(starts, ends, strict=True)], strict=True))

    def encode(self, b: TextBlock) -> list[np.ndarray]:
        """The ids of each text, and the end id."""
        end = np.array([END_ID], self.dtype)
        if not self.by_word:
            return [np.concatenate([self._ids(b.slice_bytes(i).decode()), end]) for i in range(b.n)]
        words, first = split_words(b)
        found = words.dictionary_encode()
        distinct, young, old = listed(found.dictionary), self.young, self.old
        known = [*map(young.get, distinct)]
        missed = [i for i, ids in enumerate(known) if ids is None]
        new = []
        for i in missed:
            ids = old.get(distinct[i])
            if ids is None:
                new.append(distinct[i])
            else:
                young[distinct[i]] = ids
        if new:
            self._learn(new)
        for i in missed:
            known[i] = young[distinct[i]]
        known.append(end.tobytes())
        pool = np.frombuffer(b"".join(known), self.dtype)
        count = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        at = np.insert(found.indices.to_numpy(zero_copy_only=False), first[1:], len(distinct))  # each text's end
        start, n = np.cumsum(count) - count, count[at]
        stop = np.cumsum(n)
        ids = np.empty(int(n.sum()), self.dtype)
        for a in range(0, len(at), _GATHER_WORDS):
            size, to = n[a : a + _GATHER_WORDS], stop[a : a + _GATHER_WORDS]
            lo, hi = to[0] - size[0], to[-1]
            ids[lo:hi] = pool[np.repeat(start[at[a : a + _GATHER_WORDS]] - (to - size), size) + np.arange(lo, hi)]
        cut = [0, *stop[first[1:] + np.arange(b.n)].tolist()]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return [ids[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
