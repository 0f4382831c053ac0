"""Word shingles of whole texts as sorted arrays of 64-bit hashes, for many texts at a time.

Words are runs of anything but ASCII white space, with A-Z in lower case; the bytes methods of UTF-8 texts do just that. Word hashes are
differences of a prefix sum over all bytes, so no word is touched by itself.
"""

import functools

import numpy as np

from .common import LET_GO

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))
SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_held: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of INVERSE, n of them at least; the longest that were asked for are held until freed()."""
    if not _held or len(_held[0]) < n:
        _held[:] = np.cumprod(np.full(n, BASE)), np.cumprod(np.full(n, INVERSE))
    return _held


LET_GO.append(_held.clear)


@functools.cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    table = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | _U(1)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return table, space


def word_hashes(texts: list[bytes], spans: bool = False) -> tuple:
    """Hashes of all words of all texts in order, and len(texts) + 1 bounds of each text's words; with spans also (all texts, starts, ends of words)."""
    buffer = b"\n".join(texts).lower() + b"\n"
    codes = np.frombuffer(buffer, np.uint8)
    table, space = _bytes()
    gap = space[codes]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    if gap[0] and len(ends) > len(starts):
        ends = ends[-len(starts) :] if len(starts) else ends[:0]
    up, down = _powers(1 << max(16, (len(codes) + 1).bit_length()))
    sums = np.cumsum(table[codes] * up[: len(codes)])
    before = np.where(starts > 0, sums[starts - 1], _U(0))
    hashes = mix((sums[ends - 1] - before) * down[starts]) ^ mix((ends - starts).astype(np.uint64))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, at)
    return (hashes, bounds, (buffer, starts, ends)) if spans else (hashes, bounds)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``size`` words, sorted; a shorter text is one shingle, a text without words has none."""
    words, bounds = word_hashes(texts)
    n = max(0, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs = mix(runs + BASE + words[j : j + n])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for w in words[a:b]:
                one = mix(one * BASE + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
