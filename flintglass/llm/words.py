"""Vectorised word hashing shared by the corpus operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Words are
identified by 64-bit hashes: a polynomial over random byte values, evaluated for all words of a
block at once from one prefix sum, then mixed. Texts are processed in blocks of about 128 kB, so
memory does not depend on the length of a text or of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_LUT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
for _c in range(65, 91):
    _LUT[_c] = _LUT[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_B = _U(0x9E3779B97F4A7C15)
_BINV = _U(pow(int(_B), -1, 1 << 64))
SHINGLE = 5
_SHINGLE_MUL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Grows on demand: powers of the base and of its inverse."""

    n = 0
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.n < n:
            cls.n = max(n, BLOCK + (1 << 16))
            cls.up, cls.down = _powers(_B, cls.n), _powers(_BINV, cls.n)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of consecutive texts: hash, byte start and end in its text, and the texts' bounds in ptr."""

    def __init__(self, hash, start, end, ptr, affix=None):
        self.hash, self.start, self.end, self.ptr, self.affix = hash, start, end, ptr, affix

    def __len__(self) -> int:
        return len(self.ptr) - 1


def _scan(buf: np.ndarray, cuts: np.ndarray, affixes: tuple[int, ...] = ()):
    """Words of buf, none crossing one of cuts: starts, ends, hashes, hashes of affixes.

    An affix of n bytes is the word's first (n > 0) or last (n < 0) bytes, the whole word if shorter.
    """
    solid = ~_SPACE[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(buf))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LUT[buf] * up[: len(buf)], out=total[1:])
    value = lambda a, b: mix((total[b] - total[a]) * down[a])
    more = [value(starts, np.minimum(ends, starts + n)) if n > 0 else value(np.maximum(starts, ends + n), ends) for n in affixes]
    return starts, ends, value(starts, ends), more


def _pieces(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of one long text, cut behind white space."""
    at = 0
    while at < len(buf):
        to = min(at + BLOCK, len(buf))
        while to < len(buf):
            gap = np.flatnonzero(_SPACE[buf[max(at, to - 4096) : to]])
            if len(gap):
                to = max(at, to - 4096) + int(gap[-1]) + 1
                break
            to = min(to + BLOCK, len(buf))
        yield at, to
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and its offsets; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK bytes together."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + BLOCK, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(texts: pa.Array, affixes: tuple[int, ...] = ()) -> Iterator[tuple[int, Words]]:
    """For slices of the texts: the number of the first text, and the words."""
    data, offs = utf8(texts)
    for lo, hi in slices(offs):
        a, b = int(offs[lo]), int(offs[hi])
        if hi - lo == 1 and b - a > 2 * BLOCK:
            parts = [(at, _scan(data[a + at : a + to], np.zeros(0, np.int64), affixes)) for at, to in _pieces(data[a:b])]
            starts, ends = (np.concatenate([at + p[i] for at, p in parts]) for i in (0, 1))
            hashes = np.concatenate([p[2] for _, p in parts])
            more = [np.concatenate([p[3][i] for _, p in parts]) for i in range(len(affixes))]
        else:
            starts, ends, hashes, more = _scan(data[a:b], offs[lo : hi + 1] - a, affixes)
        base = offs[lo:hi] - a
        ptr = np.append(np.searchsorted(starts, base), len(starts))
        shift = np.repeat(base, np.diff(ptr))
        yield lo, Words(hashes, starts - shift, ends - shift, ptr, more)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of width words of one text; of the whole text if it has fewer; none for none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        out += hashes[j : n - width + 1 + j] * _SHINGLE_MUL[j]
    return mix(out + _U(width))


def word_hash(word: str) -> int:
    """The hash that words() gives to one word."""
    (_, w), = words(pa.array([word]))
    return int(w.hash[0])


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of values from each start to its end (excluded); equal stretches have equal ones."""
    up, down = _Powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])
