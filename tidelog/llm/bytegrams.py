"""Byte n-grams and word hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text handled at once.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"n": np.zeros(0, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["n"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("n", _BASE), ("i", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
    return _powers["n"], _powers["i"]


class Texts:
    """Texts in one buffer: `pad` bytes of `fill` before each and after the last; text i is data[start[i]:end[i]]."""

    def __init__(self, texts: list[bytes], pad: int, fill: int = 10, align: int = 1):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        room = -(-(lengths + pad) // align) * align
        self.start = np.cumsum(room) - room + -(-pad // align) * align
        self.end = self.start + lengths
        self.data = np.full(int(room.sum()) + -(-pad // align) * align + pad, fill, np.uint8)
        for text, at in zip(texts, self.start.tolist(), strict=True):
            if text:
                self.data[at : at + len(text)] = np.frombuffer(text, np.uint8)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of values[start:end] for each text, in double precision; values runs along data."""
        return self._reduce(np.add, values, np.float64)

    def _reduce(self, f: np.ufunc, values: np.ndarray, dtype: type) -> np.ndarray:
        out = np.zeros((len(self.start), *values.shape[1:]), dtype)
        full = self.end > self.start
        if full.any():
            cuts = np.stack([self.start[full], self.end[full]], 1).ravel()
            out[full] = f.reduceat(values[: cuts[-1] + 1], cuts, dtype=dtype)[::2]
        return out

    def grams(self, n: int) -> np.ndarray:
        """Keys of the n bytes that end at each place of data; the first n - 1 hold no whole n-gram."""
        key = np.zeros(len(self.data), np.uint64)
        for k in range(n):
            key[k:] |= self.data[: len(self.data) - k].astype(np.uint64) << np.uint64(8 * k)
        return key

    def mask(self) -> np.ndarray:
        """Marks the places that belong to a text."""
        step = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(step, self.start, 1)
        np.add.at(step, self.end, -1)
        return np.cumsum(step[:-1], dtype=np.int8) > 0

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lower-cased words in order, and for each text the number of words before its end."""
        low = _LOWER[self.data]
        inside = ~_IS_SPACE[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _power_tables(1 << max(20, int(len(low)).bit_length()))
        with np.errstate(over="ignore"):
            total = np.zeros(len(low) + 1, np.uint64)
            np.cumsum(_BYTE[low] * power[: len(low)], out=total[1:])
            hashes = mix((total[stop] - total[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))
        return hashes, np.searchsorted(begin, self.end)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Slices [i, j) of texts of about limit bytes; a longer text stands alone."""
    i, size = 0, 0
    for j, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield i, j
            i, size = j, 0
        size += len(text) + 16
    if i < len(texts):
        yield i, len(texts)


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs, or the sum of its weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights, first)


class Index:
    """Places of 64-bit keys in a sorted array, found by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]  # of several for one slot the last stays
            out = self.slots[at] != rest
            rest, at = rest[out], (at[out] + 1) & (len(self.slots) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._hash(keys)
        found = self.slots[at]
        rest = np.flatnonzero((self.keys[found] != keys) & (found >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.slots) - 1)
            found[rest] = self.slots[at[rest]]
            rest = rest[(found[rest] >= 0) & (self.keys[found[rest]] != keys[rest])]
        return found
