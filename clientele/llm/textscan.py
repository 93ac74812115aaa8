"""Words and hashes of many texts at once, in numpy.

Texts of a batch are laid end to end in one byte buffer; word borders and 64-bit
word hashes come from a few passes over that buffer instead of a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
SPAN = 1 << 19                        # bytes hashed in one pass; bounds the memory of a very long text
BATCH_CHARS = 1 << 19                 # characters of texts handled together
_BASE = U64(0x9E3779B97F4A7C15)       # odd, so it has an inverse modulo 2^64
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SPAN + 64)
        for slot, base in ((0, _BASE), (1, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[slot] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; spans are sorted and do not overlap.
    Equal contents give equal hashes wherever they stand."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum((values[lo:hi].astype(U64) + U64(1)) * power[:-1], out=sums[1:])
        first = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[first]) * inverse[first]
        i = j
    return mix(out)


def batches(sizes: list[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about `limit`; a larger one stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def utf8(texts) -> list[bytes]:
    """Null becomes the empty text."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def scan_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): words are runs of other bytes than space and
    \\t to \\r; words first[d] to first[d + 1] belong to text d."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = LOWER[data]
    space = np.empty(len(data) + 1, bool)
    space[0] = True
    np.take(SPACE, data, out=space[1:])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    borders = np.concatenate([[0], np.cumsum(sizes)])
    return data, starts, ends, np.searchsorted(starts, borders)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first): see scan_words."""
    data, starts, ends, first = scan_words(texts, lower)
    return span_hashes(data, starts, ends), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one text; of the whole text if it has fewer."""
    if len(words) == 0:
        return words
    width = min(size, len(words))
    total = np.zeros(len(words) - width + 1, U64)
    for k in range(width):
        total = mix(total * _BASE + words[k:k + len(total)])
    return total


def owner(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
