"""Vectorised text kernels: words and their 64-bit hashes from batches of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte, and lower case for A-Z alone.
BYTE_VALUES = mix64(np.arange(256, dtype=U64) + U64(1 << 20))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of other bytes than the white space of ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 19) + 1, U64(base), U64)
        have[0] = U64(1)
        _powers[base] = have = np.multiply.accumulate(have)
        if len(have) > 1 << 23:  # one very long text must not keep its memory
            _powers.pop(base)
    return have[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of word bytes; a run never crosses a row."""
    w = is_word[data]
    edge = np.diff(np.concatenate([[False], w, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[w[cut] & w[cut - 1]] if len(cut) else cut
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the whole batch."""
    if not len(starts):
        return np.empty(0, U64)
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUES[data] * _power(_BASE, n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power(_BASE_INVERSE, n + 1)[starts]
    return mix64(h ^ ((ends - starts).astype(U64) << U64(48)))


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of each word of a batch of texts, in order."""
    if lower is not None:
        data = lower[data]
    starts, ends, rows = word_spans(data, offsets, is_word)
    return span_hashes(data, starts, ends), rows
