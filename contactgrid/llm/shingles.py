"""Word shingles of whole texts and BagMinHash signatures of their multisets, by numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP_BYTES = 1 << 19
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which close inputs have unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base, and of its inverse."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class WordHasher:
    """64-bit hashes of all words of many texts at once, from prefix sums of a polynomial over their bytes."""

    def __init__(self) -> None:
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up, self.down = powers(n)

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes and the text that each is in; texts are data's bytes up to each of ends."""
        if not len(data):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(data) > len(self.up):
            self._grow(2 * len(data))
        full = ~_GAPS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        edge[0] = True
        first = full.copy()
        first[1:] &= ~full[:-1] | edge[1:-1]
        last = full.copy()
        last[:-1] &= ~full[1:] | edge[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        hashes = mix((sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64))
        return hashes, np.searchsorted(ends, a, "right")


def steps(column: pa.Array, step_bytes: int = _STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of as many texts as a step holds; a long text is a step of its own."""
    column = column.cast(pa.large_string())
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if offsets is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step_bytes, "right")) - 1)
        j = min(j, len(column))
        yield i, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def shingle_sets(column: pa.Array, size: int, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, shingle, row, count): the multisets of shingles of a step's texts, by row and shingle.

    A shingle is ``size`` consecutive words; a text of fewer words has one, of all its words; a text
    without words has none.
    """
    for start, data, ends in steps(column):
        words, row = hasher.words(data, ends)
        n = len(ends)
        per = np.bincount(row, minlength=n)
        h = np.zeros(len(words), np.uint64)
        for k in range(size):
            shifted = words[k:] if k else words
            h[: len(words) - k] = h[: len(words) - k] * np.uint64(_BASE) + shifted
        place = np.arange(len(words)) - np.repeat(np.cumsum(per) - per, per)
        whole = place + size <= per[row]
        short = (place == 0) & (per[row] < size)
        for i in np.flatnonzero(short):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in words[i : i + per[row[i]]]:
                    x = x * np.uint64(_BASE) + w
                h[i] = x + np.uint64(per[row[i]])
        use = whole | short
        h, r = mix(h[use]), row[use]
        cuts = np.searchsorted(r, np.arange(n + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        yield start, n, h[at], r[at], np.diff(np.append(at, len(h)))


def counted(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A multiset as the sorted set of its (shingle, how manieth) members, hashed."""
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(mix(np.repeat(shingle, count) + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def bag_minhash(shingle: np.ndarray, row: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures, n rows of m values of 32 bits; rows without shingles are 0.

    Weights are discretised to whole numbers. A shingle's levels 1, 2, 3-4, 5-8, ... are bands, each with a
    Poisson process of its own, of as many points a unit of time as it has levels. A point in a band falls to
    one of its levels, at random by its hash, and counts if the weight reaches that level: so a larger weight
    sees all points of a smaller one. A point belongs to one of m registers; each keeps its earliest point.
    Two bags agree in a register with the probability of their weighted Jaccard similarity. Points are
    made in the order of time up to a limit at which, likely, all registers have one; where not,
    the row's limit doubles.
    """
    found = np.full(n * m, np.uint64(0xFFFFFFFFFFFFFFFF))
    bands = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 1)
    entry = np.repeat(np.arange(len(shingle)), bands)
    band = np.arange(len(entry)) - np.repeat(np.cumsum(bands) - bands, bands)
    low = np.where(band > 0, 1 << np.maximum(band - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mix(shingle[entry] + band.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    weight, of = count[entry], row[entry]
    load = np.bincount(row, weights=count, minlength=n)
    factor = 3.0
    todo = np.ones(len(entry), bool)
    while todo.any():
        alive = np.flatnonzero(todo)
        limit = m * (np.log(m) + factor) / np.maximum(load, 1)
        time, k = np.zeros(len(alive)), 0
        while len(alive):
            k += 1
            draw = mix(seed[alive] + np.uint64(k * 0x9FB21C651E98DF25 % 2**64))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / width[alive]
            on = time <= limit[of[alive]]
            alive, time, draw = alive[on], time[on], mix(draw[on] + np.uint64(1))
            level = low[alive] + 1 + ((draw >> np.uint64(32)) % width[alive].astype(np.uint64)).astype(np.int64)
            seen = level <= weight[alive]
            register = of[alive] * m + (draw % np.uint64(m)).astype(np.int64)
            point = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(draw) >> np.uint64(32))
            np.minimum.at(found, register[seen], point[seen])
        empty = (found.reshape(n, m) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1) & (load > 0)
        todo = empty[of]
        factor = 2 * factor + np.log(m)
    return np.where(load[:, None] > 0, found.reshape(n, m), 0).astype(np.uint32)
