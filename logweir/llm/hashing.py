"""Words and shingles of whole texts as 64-bit hashes, over arrays of bytes."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.cache
def _tables(bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """A value for each byte, the same for either case of A-Z, and whether it parts words: ASCII white space, or (bare)
    all ASCII but letters and digits."""
    lower = np.arange(256)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    if bare:
        space[[i for i in range(128) if not chr(i).isalnum()]] = True
    return mix(lower.astype(U) * U(0x632BE59BD9B4E019) + U(1)), space


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, U(_P)), np.full(size, U(_INV))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _bundles(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes; a longer text goes alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def _word_hashes(own: np.ndarray, cut: np.ndarray, value: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of some bytes; a word ends where cut is true."""
    inside = ~space[own]
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(1 << max(20, int(len(own)).bit_length()))
    total = np.concatenate([np.zeros(1, U), np.cumsum(value[own] * up[: len(own)], dtype=U)])
    return start, mix((total[end] - total[start]) * down[start])


def words(texts: pa.Array, most: int = 1 << 20, bare: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes of the words of a range of texts, offsets of its texts in them). A-Z counts as a-z; bare words have no ASCII
    punctuation. A text of more than `most` bytes is hashed in pieces that end between words."""
    data, offsets = _flat(texts)
    value, space = _tables(bare)
    for first, last in _bundles(offsets, most):
        own = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        if len(own) <= most:
            cut = np.zeros(len(own) + 1, bool)
            cut[at] = True
            start, hashes = _word_hashes(own, cut, value, space) if len(own) else (np.empty(0, np.int64), np.empty(0, U))
            yield first, hashes, np.searchsorted(start, at)
            continue
        parts, a = [], 0
        while a < len(own):
            b = min(len(own), a + most)
            while b < len(own) and not space[own[b]]:  # a longer word stays whole
                b += 1
            parts.append(_word_hashes(own[a:b], np.zeros(b - a + 1, bool), value, space)[1])
            a = b
        hashes = np.concatenate(parts)
        yield first, hashes, np.array([0, len(hashes)])


def shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its sorted distinct k-word shingles); a text of fewer words has the whole sequence as one,
    a text without words none."""
    for first, w, at in words(texts):
        n = len(w) - k + 1
        if n > 0:
            grams = np.zeros(n, U)
            for i in range(k):
                grams = grams * _STEP + w[i : i + n]
            grams = mix(grams + U(k))
        for i in range(len(at) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield first + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                whole = U(0)
                with np.errstate(over="ignore"):
                    for x in w[a:b]:
                        whole = whole * _STEP + x
                    yield first + i, mix(np.array([whole + U(b - a)], U))
            else:
                yield first + i, np.empty(0, U)


def windows(w: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, U)
    up, down = _powers(1 << max(20, len(w).bit_length()))
    total = np.concatenate([np.zeros(1, U), np.cumsum(w * up[: len(w)], dtype=U)])
    return mix((total[k:] - total[:-k]) * down[:n])
