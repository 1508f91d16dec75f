"""Words, lines and hashes of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n, modulo 2^64; those of a usual piece are kept."""
    if n > 2 * CHUNK_BYTES:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)
    if base not in _POWERS:
        p = np.full(2 * CHUNK_BYTES + 1, base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][: n + 1]


class Texts:
    """Consecutive texts: ``data`` holds their bytes, text i is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes in ``inside``, cut where texts end."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(len(inside) + 1, bool)
        cut[self.bounds] = True
        cut[0] = cut[-1] = True
        before = np.empty(len(inside), bool)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty(len(inside), bool)
        after[-1], after[:-1] = False, inside[1:]
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])

    def owner(self, places: np.ndarray) -> np.ndarray:
        """The text each place lies in; ``places`` ascend."""
        counts = np.diff(np.searchsorted(places, self.bounds))
        return np.repeat(np.arange(len(self)), counts)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of ``data[start:end]``, equal for equal bytes wherever they lie.

        A polynomial over random byte values by running sums; two different strings
        agree with a chance of about 2^-64.
        """
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * powers(_BASE, n)[:n], out=sums[1:])
        shifted = (sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts]
        return mixed(shifted + (ends - starts).astype(np.uint64))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, Texts]]:
    """First row and texts of pieces of about ``limit`` bytes and ``rows`` texts; NULL is the empty text.

    A text above the limit is a piece of its own: memory follows the longest text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, len(column))
        yield first, Texts(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def windows(hashed: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first place of all ``n``-word windows that stay inside their text."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    many = len(hashed) - n + 1
    total = np.zeros(many, np.uint64)
    for j in range(n):
        total = total * np.uint64(_BASE) + hashed[j : j + many]
    places = np.flatnonzero(owner[:many] == owner[n - 1 :])
    return mixed(total[places]), places


def long_windows(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, by running sums; the windows across texts are among them."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * powers(_BASE, len(hashed))[:-1], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * powers(_INVERSE, len(hashed))[: len(hashed) - n + 1])


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by text."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


class Tally:
    """Sums by 64-bit key of what many chunks add; memory follows the distinct keys."""

    def __init__(self, columns: int, pending: int = 1 << 21):
        self.columns, self.most, self.size = columns, pending, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((keys, *values))
        self.size += len(keys)
        if self.size > self.most:
            keys, values = self.sums()
            self.parts, self.size = [(keys, *values)], 0
            self.most = max(self.most, 2 * len(keys))

    def sums(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.parts:
            return np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * self.columns
        keys, *values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], [np.add.reduceat(v[order], first) if len(first) else v for v in values]
