"""Token ids of whole texts, by a public tokenizer's file: numpy cuts texts into runs, the library encodes each distinct run once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from contactgrid.llm.shingles import mix, powers, steps

#: Runs that one worker keeps at most. When there are more, it starts anew; ids do not depend on it.
CACHE_RUNS = 1 << 19
#: Bytes of text that are encoded together, and runs that the library gets in one string.
STEP_BYTES, STEP_RUNS = 1 << 20, 200

GAP, LETTER, DIGIT, SYMBOL, HARD = range(5)
_KIND = np.full(256, HARD, np.uint8)
_KIND[33:127] = SYMBOL
_KIND[[9, 10, 11, 12, 13, 32]] = GAP
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = LETTER
_KIND[ord("'")] = HARD
#: The second bytes of small Latin-1 letters for which byte-level vocabularies write another character.
_SHOWN = (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _shown(run: bytes) -> str:
    text = run.decode("latin-1")
    for byte, character in _SHOWN:
        text = text.replace(byte, character)
    return text


class Slots:
    """A hash table of up to n 64-bit keys, numbered as they come; looked up and filled by whole arrays."""

    def __init__(self, n: int):
        self.bits = (2 * n).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)
        self.size = 0

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for those that aren't there."""
        at = self._start(keys)
        found = self.number[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.number[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return found

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that aren't there get the next numbers, in order."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        at, left = self._start(keys), np.arange(len(keys))
        while len(left):
            free = left[self.number[at[left]] < 0]
            self.number[at[free]] = numbers[free]
            placed = free[self.number[at[free]] == numbers[free]]  # of those that want one slot, the last has it
            self.keys[at[placed]] = keys[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] = (at[left] + 1) & (len(self.keys) - 1)


class RunTokenizer:
    """Encodes as ``tokenizers`` does with add_special_tokens=False.

    The tokenizer's pattern never matches across white space, lowers case, and takes a run of letters, one digit, or a run
    of other symbols. So a text's ids are those of its runs, one after the other, and a run is encoded when it is first
    met. Chunks between white space that hold an apostrophe, ``<|``, a control character, or anything outside ASCII and
    the letters of Latin-1 are runs of their own, encoded as they stand. Runs are known by 64 bits of hash.
    """

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        last = [i for token, i in self.whole.get_vocab().items() if token.endswith("</w>")]
        self.is_last = np.zeros(1 + max(self.whole.get_vocab().values()), bool)
        self.is_last[last] = True
        self.cache_runs = cache_runs
        self.powers = powers(1 << 16)
        self._forget()

    def _forget(self) -> None:
        self.slots = Slots(self.cache_runs)
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)

    def _store(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n, filled = self.slots.size, int(self.ends[self.slots.size])
        while len(self.ends) < n + len(keys) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < filled + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[filled : filled + len(ids)] = ids
        self.ends[n + 1 : n + len(keys) + 1] = filled + np.cumsum(counts)
        self.slots.add(keys)

    def _learn(self, keys: np.ndarray, runs: list[bytes], plain: np.ndarray) -> None:
        """Plain runs are one match each, so a token with a word's end is a run's last; the others are encoded by themselves.

        A plain run is normal already, so it takes the model alone; its bytes beyond ASCII are the characters that stand for them.
        """
        easy = np.flatnonzero(plain)
        joined = (b" ".join(runs[i] for i in easy[k : k + STEP_RUNS]) for k in range(0, len(easy), STEP_RUNS))
        ids = [np.array(self.bare.encode(_shown(x), add_special_tokens=False).ids, np.uint32) for x in joined]
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        self._store(keys[easy], ids, np.diff(np.flatnonzero(self.is_last[ids]) + 1, prepend=0))
        hard = np.flatnonzero(~plain)
        found = self.whole.encode_batch_fast([runs[i].decode() for i in hard], add_special_tokens=False)
        self._store(keys[hard], np.array([t for x in found for t in x.ids], np.uint32), np.array([len(x.ids) for x in found], np.int64))

    def _runs(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and kinds of the runs; letters outside hard runs are lowered in place."""
        kind = _KIND[data]
        lead = data[:-1] == 0xC3
        if lead.any():  # C3 leads the two bytes of Latin-1's letters, and of two signs
            after = data[1:]
            letter = np.flatnonzero(lead & (after != 0x97) & (after != 0xB7))
            kind[letter] = kind[letter + 1] = LETTER
        kind[:-1][(data[:-1] == ord("<")) & (data[1:] == ord("|"))] = HARD
        full = kind != GAP
        hard = np.flatnonzero(kind == HARD)
        if len(hard):
            first, last = full.copy(), full.copy()
            first[1:] &= ~full[:-1] | edge[1:-1]
            last[:-1] &= ~full[1:] | edge[1:-1]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            of = np.unique(np.searchsorted(a, hard, "right") - 1)
            n = b[of] - a[of]
            kind[np.repeat(a[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = HARD
        soft = kind != HARD
        np.copyto(data, _LOWER[data], where=soft)
        if lead.any():
            up = letter[soft[letter] & (data[letter + 1] <= 0x9E)] + 1
            data[up] += 0x20
        new = np.ones(len(kind) + 1, bool)
        new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | edge[1:-1]
        bounds = np.flatnonzero(new)
        a, b = bounds[:-1], bounds[1:]
        of = kind[a]
        there = of != GAP
        return a[there], b[there], of[there]

    def _hashes(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
        if len(data) > len(self.powers[0]):
            self.powers = powers(2 * len(data))
        up, down = self.powers
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[b] - sums[a]) * down[a] + (kind == HARD) * np.uint64(0xD1B54A32D192ED03))

    def _step(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(ends), np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        data = data.copy()
        a, b, kind = self._runs(data, edge)
        keys = self._hashes(data, a, b, kind)
        at = self.slots.find(keys)
        if (at < 0).any():
            for fresh in (False, True):
                missing = np.flatnonzero(at < 0)
                new, first = np.unique(keys[missing], return_index=True)
                if fresh or self.slots.size + len(new) <= self.cache_runs:
                    break
                self._forget()
                if len(keys) > self.cache_runs:
                    self.slots = Slots(len(keys))
                at[:] = -1
            first = missing[first]
            raw = data.tobytes()
            runs = [raw[x:y] for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True)]
            self._learn(new, runs, kind[first] != HARD)
            at = self.slots.find(keys)
        start = self.ends[at]
        n = self.ends[at + 1] - start
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(start - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.append(0, upto)[np.searchsorted(a, ends, "left")]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ends) of as many texts as a step holds: the ids of all, as uint32, and where each text's end; none for null."""
        for start, data, ends in steps(texts, STEP_BYTES):
            if len(data) <= 2 * STEP_BYTES:
                yield start, *self._step(data, ends)
            else:  # one long text
                ids = np.concatenate([self._step(x, np.array([len(x)]))[0] for x in _parts(data)])
                yield start, ids, np.array([len(ids)])


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about STEP_BYTES that end at white space."""
    at = 0
    while at < len(data):
        end = at + STEP_BYTES
        while end < len(data) and not len(gaps := np.flatnonzero(_KIND[data[end : end + STEP_BYTES]] == GAP)):
            end += STEP_BYTES
        end = min(len(data), end + int(gaps[0])) if end < len(data) else len(data)
        yield data[at:end]
        at = end
