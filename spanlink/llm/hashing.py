"""Vectorised word and shingle hashes over Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULT), -1, 2**64))
_PLACE = _rng.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of consecutive words that are hashed at once; a longer word is hashed alone.
PART = 1 << 18


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n and more of the multiplier and its inverse; those of PART bytes stay with the worker."""
    global _powers
    if len(_powers[0]) > n:
        return _powers
    made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PART), m, np.uint64)])) for m in (_MULT, _INVERSE))
    if n <= PART:
        _powers = made
    return made


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = texts.type == pa.large_string()
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and for each text the index of its first word (n+1 entries)."""
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PART, "right")))
        part, a, b = body[base : ends[to - 1]], starts[at:to] - base, ends[at:to] - base
        up, down = _power_tables(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        out[at:to] = (total[b] - total[a]) * down[a]
        at = to
    return mix(out), np.searchsorted(starts, offsets)


def slices(texts: pa.Array, most: int = PART):
    """Consecutive slices of at most `most` bytes of text, each one text at least: (first row, array)."""
    offsets = text_buffer(texts)[1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array, k: int = 5):
    """For each text the sorted distinct hashes of its k-word shingles.

    A text with 1 to k-1 words has one shingle, its whole sequence; a null, empty or blank text has none.
    """
    for _, part in slices(texts):
        words, first = word_hashes(*text_buffer(part))
        n = len(words)
        grams = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k if n >= k else 0):
            grams += words[j : n - k + 1 + j] * _PLACE[j]
        grams = mix(grams)
        for i in range(len(part)):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
