"""Word-shingle hashes of whole texts, computed over batches of bytes with array operations.

A word is a run of bytes other than the ASCII blanks. A text of fewer words than a shingle has one
shingle, all of its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _BASE, np.uint64))])
            _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _INVERSE, np.uint64))])


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with the hash of data[a:b] = (P[b] - P[a]) * inverse(a), modulo 2^64."""
    _grown(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * _inverses[start]


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and the offsets at which each text's begin and end."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    edges = np.cumsum([1, *(len(t) + 1 for t in texts)])  # where each text starts
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    change = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = change[::2], change[1::2]
    prefix = prefix_hash(data)
    words = mixed64(span_hash(prefix, start, end) + (end - start).astype(np.uint64))
    first = np.searchsorted(start, edges)  # index of each text's first word
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    offset = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offset[-1]) + np.repeat(first[:-1] - offset[:-1], count)
    stop = np.repeat(first[1:], count)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    short = bool((n < width).any())
    for j in range(width):
        term = padded[at + j]
        if short:
            term = np.where(at + j < stop, term, np.uint64(0))
        out = out * np.uint64(0xD6E8FEB86659FD93) + term
    return mixed64(out), offset


def pieces(texts: list[bytes], limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts with about ``limit`` bytes each, a longer text alone."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield low, i
            low, held = i, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)
