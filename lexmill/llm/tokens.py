"""Words and their 64-bit hashes for many texts at once, on the UTF-8 bytes, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
#: Powers are kept for places below 1 << BLOCK_BITS; any other is the product of two.
BLOCK_BITS = 16
_low: dict[int, np.ndarray] = {}


def _table(separators: bytes) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Lower-cased letters, digits and everything outside ASCII; the rest separates.
WORDS = _table(bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
#: Lower-cased runs of anything but white space (tab to carriage return, space); NUL is mapped to a byte UTF-8 never has.
BLANKS = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
BLANKS[0] = 0xFF


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i for i below a block, and base^(block * j) for each block of n places."""
    size = 1 << BLOCK_BITS
    if base not in _low:
        _low[base] = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))))
    step = np.uint64(pow(base, size, 1 << 64))
    return _low[base], np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n >> BLOCK_BITS, step, np.uint64))))


def power(places, inverse: bool = False) -> np.ndarray:
    """P^i (or P^-i) modulo 2^64 for each place i."""
    places = np.asarray(places, np.int64)
    low, high = _power_tables(int(places.max(initial=0)), pow(_P, -1, 1 << 64) if inverse else _P)
    return low[places & ((1 << BLOCK_BITS) - 1)] * high[places >> BLOCK_BITS]


def _partial_sums(values: np.ndarray):
    """(start, sums of values[i] * P^i from 0 up to and with each place) of each block."""
    low, high = _power_tables(len(values), _P)
    total = np.uint64(0)
    for k, start in enumerate(range(0, len(values), 1 << BLOCK_BITS)):
        part = values[start : start + (1 << BLOCK_BITS)]
        part = np.cumsum(part * low[: len(part)], dtype=np.uint64) * high[k] + total
        yield start, part
        total = part[-1]


def prefix_at(values: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """Sums of values[i] * P^i for i below each place, for each array of rising places; memory goes with them and a block, not with the values."""
    out = [np.zeros(len(x), np.uint64) for x in places]
    done = [0] * len(places)
    for start, sums in _partial_sums(values):
        for k, x in enumerate(places):
            a = done[k]
            z = done[k] = a + int(np.searchsorted(x[a : a + 2 * len(sums)], start + len(sums), side="right"))
            at = x[a:z] - (start + 1)
            out[k][a:z] = sums[at]
            if a == 0 and z and x[0] == 0:
                out[k][: int(np.searchsorted(x[:z], 0, side="right"))] = 0
    return out


def prefix(values: np.ndarray) -> np.ndarray:
    """prefix_at() for every place from 0 to the end."""
    out = np.zeros(len(values) + 1, np.uint64)
    for start, sums in _partial_sums(values):
        out[start + 1 : start + 1 + len(sums)] = sums
    return out


@dataclass
class Words:
    """Words in page order: document index, byte start and end, hash; counts per document."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each document's first word, and the total at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """Split each document of the concatenated bytes at the table's separators."""
    n_docs = len(offs) - 1
    mapped = table[data]
    inside = mapped != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    del inside, opens, closes
    upto, before = prefix_at(mapped, end, start)
    hashed = mix((upto - before) * power(start, True) + (end - start).astype(np.uint64))
    counts = np.diff(np.searchsorted(start, offs)) if n_docs else np.zeros(0, np.int64)
    return Words(np.repeat(np.arange(n_docs), counts), start, end, hashed, counts)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of each run of `size` words; a document with fewer words, but not none, is one shingle."""
    n = len(w.hash)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled[: n - j] += w.hash[j:] * power(j + 1)
    first = w.first
    place = np.arange(n) - first[w.doc]
    left = w.counts[w.doc] - place
    keep = (left >= size) | ((place == 0) & (w.counts[w.doc] < size))
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    for d in short:
        own = w.hash[first[d] : first[d + 1]]
        rolled[first[d]] = np.bitwise_xor.reduce(mix(own + np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))) + np.uint64(len(own))
    return w.doc[keep], mix(rolled[keep])
