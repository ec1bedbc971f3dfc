"""Words of many texts at once: 64-bit hashes from the bytes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0xD1342543DE82EF97
_MIX = 0x9E3779B97F4A7C15
#: Each byte's value in a word's hash, and the same with A-Z as a-z. White space parts words.
_VALUE = np.arange(1, 257, dtype=np.uint64)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed together, about.
PIECE = 1 << 18


class _Powers:
    """Powers of the base of word hashes, and of its inverse, grown as wanted."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                setattr(cls, name, np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, np.uint64(base)))]))


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the words [begin, end) of one piece of bytes."""
    _Powers.reach(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_FOLDED if fold else _VALUE)[data] * _Powers.up[: len(data)])])
    x = (sums[end] - sums[begin]) * _Powers.down[begin] + (end - begin).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def word_hash(word: bytes, fold: bool = True) -> np.uint64:
    return _hashes(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.full(1, len(word)), fold)[0]


def hashed_words(texts: pa.Array, fold: bool, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes, cuts) of groups of texts of about `piece` bytes; a longer text is a group, whose bytes go a piece at a time.

    Words are parted by ASCII white space; fold: A-Z count as a-z. The words
    of text first + i are hashes[cuts[i] : cuts[i + 1]]. Null texts are empty.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
        to = min(to, len(texts))
        group, cuts = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        blank = _SPACE[group]
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        inner = cuts[1:-1]
        inner = inner[(inner > 0) & (inner < len(group))]
        first[inner], last[inner - 1] = ~blank[inner], ~blank[inner - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        words = np.zeros(len(begin), np.uint64)
        done = 0
        while done < len(begin):
            upto = max(done + 1, int(np.searchsorted(end, begin[done] + 2 * piece, side="right")))
            low = begin[done]
            words[done:upto] = _hashes(group[low : end[upto - 1]], begin[done:upto] - low, end[done:upto] - low, fold)
            done = upto
        yield at, words, np.searchsorted(begin, cuts)
        at = to
