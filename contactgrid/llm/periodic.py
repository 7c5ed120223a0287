"""Periodic runs of words: maximal pairs, found bottom-up in the tree of LCP intervals, are the runs."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words that a pair has in common at least: a run of period q has at least max(6, 4 q) - q of them.
LEAST_COMMON = 5
#: Words of the documents that are searched together, about.
STEP_WORDS = 1 << 19

RUNS = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
                  ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
RUNS_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _named(letters: np.ndarray, at: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the k + 1 words at each place, in their order, and how often each is there; name: the numbers of the first k."""
    _, name, n = np.unique(name * (len(letters) + 1) + letters[at + k] + 1, return_inverse=True, return_counts=True)
    return name, n[name]


def _candidates(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of which the next five words occur again in their document, ascending: the leaves of LCP intervals of five words or more.

    Letters are a document's own, so no two documents share any; ends are, of each place, where its document ends.
    """
    at = np.flatnonzero(np.arange(len(ends)) + LEAST_COMMON <= ends)
    name = np.zeros(len(at), np.int64)
    for k in range(LEAST_COMMON):
        name, n = _named(letters, at, name, k)
        at, name = at[n > 1], name[n > 1]
    return at


def _suffixes(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The candidate places in the order of their suffixes, by prefix doubling of those still tied.

    A tied place's rest is looked up as the rank of the place behind its common words: of those, too, five words are ranked. One that isn't a candidate is alone in its rank.
    """
    ranked = np.union1d(at, at + LEAST_COMMON)
    name = np.zeros(len(ranked), np.int64)
    for k in range(LEAST_COMMON):
        name, _ = _named(letters, ranked, name, k)
    sizes = np.bincount(name)
    rank = np.full(len(letters), -1, np.int64)
    rank[ranked] = (np.cumsum(sizes) - sizes)[name]
    tied, step = at, LEAST_COMMON
    while len(tied):
        old, after = rank[tied], rank[tied + step]
        order = np.lexsort((after, old))
        tied, old, after = tied[order], old[order], after[order]
        place = np.arange(len(tied))
        new = np.r_[True, (old[1:] != old[:-1]) | (after[1:] != after[:-1])]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        rank[tied] = old + np.maximum.accumulate(np.where(new, place, 0)) - group
        tied = tied[~(new & np.r_[new[1:], True])]
        step *= 2
    return at[np.argsort(rank[at])]


def _common(suffixes: np.ndarray, letters: list[int]) -> list[int]:
    """Of each suffix, how many words it shares with the one before; 0 where that is under five. Found in text order, where it falls by one at most."""
    before = dict(zip(suffixes[1:].tolist(), suffixes[:-1].tolist(), strict=True))
    shared, last, n = {}, -2, 0
    for i in np.sort(suffixes).tolist():
        j = before.get(i, -1)
        n = n - 1 if i == last + 1 and n > LEAST_COMMON else 0
        last = i
        if j < 0:
            n = 0
            continue
        while letters[i + n] == letters[j + n]:
            n += 1
        shared[i] = n
    return [shared[i] if shared.get(i, 0) >= LEAST_COMMON else 0 for i in suffixes.tolist()]


class _Interval:
    """The places of an LCP interval, ascending, and the same by the word that stands left of them."""

    __slots__ = ("by_left", "places")

    def __init__(self, place: int, left: int):
        self.places, self.by_left = [place], {left: [place]}


def _merge(a: _Interval, b: _Interval, common: int, left: list[int], found: dict[tuple[int, int], int]) -> _Interval:
    """Joins two parts of an LCP interval; pairs between them have ``common`` words in common, and are maximal where their left words differ.

    Only pairs as near as a run needs are looked at: through the lists of the other left words, or through the places near by, whichever are fewer.
    """
    if len(a.places) < len(b.places):
        a, b = b, a
    far = common // (LEAST_EXPONENT - 1)
    for x in b.places:
        mine, low = left[x], bisect_left(a.places, x - far)
        near = bisect_right(a.places, x + far, low) - low
        if not near:
            continue
        if near <= len(a.by_left):
            others = [y for y in a.places[low : low + near] if left[y] != mine]
        else:
            others = [y for word, ys in a.by_left.items() if word != mine for y in ys[bisect_left(ys, x - far) : bisect_right(ys, x + far)]]
        for y in others:
            start, period = min(x, y), abs(x - y)
            run = (start, start + period + common)
            if period < found.get(run, period + 1):  # a multiple of the period gives the same run
                found[run] = period
    for x in b.places:
        insort(a.places, x)
    for word, xs in b.by_left.items():
        mine = a.by_left.setdefault(word, [])
        for x in xs:
            insort(mine, x)
    return a


def maximal_pairs(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], int]:
    """(start, end) of every run of the documents in ``letters``, and its period. starts and ends: of each place, its document's bounds."""
    n = len(letters)
    letters = np.r_[letters, np.full(2 * LEAST_COMMON, -1)]  # an end that is no word
    at = _candidates(letters, ends)
    if not len(at):
        return {}
    suffixes, words = _suffixes(letters, at), letters.tolist()
    left = np.where(np.arange(n) > starts, np.r_[-1, letters[: n - 1]], -1).tolist()
    found: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, _Interval]] = []
    last = None
    for place, common in zip([*suffixes.tolist(), -1], [*_common(suffixes, words), 0], strict=True):
        if last is not None:
            while open_ and open_[-1][0] > common:
                depth, part = open_.pop()
                last = _merge(part, last, depth, left, found)
            if common and open_ and open_[-1][0] == common:
                last = _merge(open_.pop()[1], last, common, left, found)
            if common:
                open_.append((common, last))
        if place >= 0:
            last = _Interval(place, left[place])
    return found


def _planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word each word becomes, for the tenth of all documents that are made periodic; None: all stay."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    index = np.arange(n)
    index[a:] = a + (index[a:] - a) % p
    return index


def _row(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            change[s + q] += 1
            change[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    figures = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha256(told.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest())


def _search(docs: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    number = defaultdict(count().__next__)
    ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for _, w in docs]
    sizes = np.array([len(w) for _, w in docs])
    first = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(docs)), sizes)
    letters = np.unique(np.concatenate(ids) * len(docs) + own, return_inverse=True)[1].astype(np.int64)
    starts = np.repeat(first, sizes)
    runs = [[] for _ in docs]
    for (start, end), period in maximal_pairs(letters, starts, starts + np.repeat(sizes, sizes)).items():
        d = int(own[start])
        runs[d].append((start - int(first[d]), end - start, period))
    rows = [_row(doc_id, w, r) for (doc_id, w), r in zip(docs, runs, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RUNS, strict=True)], schema=RUNS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            words = (text.as_py() or b"").split()  # bytes are split at the six ASCII spaces alone
            index = _planted(doc_id, len(words))
            held.append((doc_id, words if index is None else [words[i] for i in index.tolist()]))
            size += len(words)
            if size >= STEP_WORDS:
                yield _search(held)
                held, size = [], 0
    if held:
        yield _search(held)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Of each document the runs of its words: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    A run is a stretch with smallest period q and at least max(6, 4 q) words that can't be extended; a tenth of all documents, by the
    checksum of their id, are made periodic first. A run that starts at s is the pair (s, s + q) of equal words up to the run's end, which
    differ in the word before and the word after: a maximal pair. Suffixes whose first five words occur again are sorted, their LCP intervals are joined bottom-up, and
    of each join come the pairs near enough; a pair's distance that is a multiple of the period gives the same stretch, of which the least counts.
    start, length and period are those of the run with the greatest length by period (of equal ones the first, then the shortest period).
    collapsed_sha256 is the digest of the words outside of all runs' repetitions, joined by spaces.

    A document's suffixes are sorted in its own task, with others up to about half a million words; nothing is shuffled.
    Null text: no words. No run: null figures, the digest of nothing, and that of all words. Null doc_id: stays null, and its words stay as they are. Repeated rows: each is a
    row. Other columns are not read. No rows: no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_runs, RUNS_DDL)
