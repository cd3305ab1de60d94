"""The merge loop of byte-pair training over arrays: each task holds a part of the distinct words, all agree on every merge."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np

GONE, BETWEEN = -2, -1  # symbols: eaten by a merge, between words
NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int64)  # pairs and counts


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.astype(np.int64).tobytes() for a in arrays)


def _unpack(message: bytes, n: int) -> np.ndarray:
    return np.frombuffer(message, np.int64).reshape(n, -1)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, the distinct ones, and where each begins in that order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return order, ordered[first], first


class Part:
    """Words of one task in a row, as linked symbols.

    A pair is known by the position of its left symbol.  `where` has the positions at which a pair arose; those that
    don't hold it any more are left out when it is merged.  A merge ends a symbol at each position, so all merges
    together do no more work than the words have characters.
    """

    def __init__(self, words: list[str], freqs: np.ndarray):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(int(ends[-1]) + 1, np.uint32)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.codes = np.unique(text[inside])
        self._text, self._ends = text, ends
        self.next, self.prev = np.arange(1, len(text) + 1, dtype=np.int32), np.arange(-1, len(text) - 1, dtype=np.int32)
        self.freq, self.word = np.asarray(freqs, np.int64), np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends))
        self.word = np.concatenate([self.word, self.word[-1:]])
        self.where: dict[int, list[np.ndarray]] = defaultdict(list)

    def begin(self, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols are the ids of all parts' characters from now on; the pairs and their counts here."""
        self.sym = np.full(len(self._text), BETWEEN, np.int32)
        if len(codes):
            self.sym = ids[np.minimum(np.searchsorted(codes, self._text), len(codes) - 1)]
            self.sym[self._ends] = BETWEEN
        del self._text, self._ends
        left = np.flatnonzero((self.sym[:-1] >= 0) & (self.sym[1:] >= 0)).astype(np.int32)
        return self._arisen(left)

    def _keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self.sym[at], self.sym[self.next[at]]
        both = (left >= 0) & (right >= 0)
        return at[both], left[both].astype(np.int64) << 32 | right[both]

    def _counted(self, at: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.freq[self.word[at[order]]], first) if len(at) else np.zeros(0, np.int64)

    def _arisen(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, keys = self._keys(at)
        order, found, first = _groups(keys)
        here = at[order]
        for key, x, y in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(here)]):
            self.where[key].append(here[x:y])
        return found, self._counted(at, order, first)

    def merge(self, left: int, right: int, to: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs and what their counts change by, from the left and without overlaps."""
        held = self.where.pop(left << 32 | right, None)
        if held is None:
            return [NOTHING]
        at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
        at = at[(self.sym[at] == left) & (self.sym[self.next[at]] == right)]
        if left == right and len(at):  # of a row of overlapping ones every second
            new = np.concatenate([[True], self.next[at[:-1]] != at[1:]])
            start = np.flatnonzero(new)
            at = at[(np.arange(len(at)) - start[np.cumsum(new) - 1]) % 2 == 0]
        if not len(at):
            return [NOTHING]
        eaten = self.next[at]
        old, keys = self._keys(np.unique(np.concatenate([self.prev[at], at, eaten])))
        order, found, first = _groups(keys)
        lost = found, -self._counted(old, order, first)
        after = self.next[eaten]
        self.sym[at], self.sym[eaten] = to, GONE
        self.next[at], self.prev[after] = after, at
        return [lost, self._arisen(np.unique(np.concatenate([self.prev[at], at])))]


def loop(words: list[str], freqs: np.ndarray, vocabulary, target: int, gather=lambda message: [message]) -> None:
    """Fills the vocabulary with the characters by code point and the merges, the same in every part; `gather` gives all parts' messages to each.

    The most frequent pair is merged, of several the lowest.  A round merges further ones where nothing that it
    does can bring another pair before them: a new pair counts at most what a pair with one of the merged symbols
    did, so those are merged that come before all of these, are alone with their count and share no symbol with them.
    """
    part = Part(words, freqs)
    codes = np.unique(np.concatenate([_unpack(m, 1)[0] for m in gather(_pack(part.codes))]))
    ids = np.array([vocabulary.add(chr(c)) for c in codes.tolist()], np.int32)
    changes, names = [part.begin(codes, ids)], vocabulary.tokens
    counts: dict[int, int] = defaultdict(int)
    heap: list[tuple[int, str, str, int]] = []

    def top():
        while heap:
            if counts.get(heap[0][3], 0) == -heap[0][0]:
                return heap[0]
            heapq.heappop(heap)
        return None

    while len(vocabulary) < target:
        touched = set()
        for message in gather(_pack(*(np.concatenate(x) for x in zip(*changes)))):
            for key, n in zip(*_unpack(message, 2).tolist()):
                counts[key] += n
                touched.add(key)
        for key in touched:
            if counts[key] > 0:
                heapq.heappush(heap, (-counts[key], names[key >> 32], names[key & 0xFFFFFFFF], key))
            else:
                del counts[key]
        changes, used = [], set()
        while len(vocabulary) < target and (best := top()) is not None:
            n, left, right, key = best
            while (other := top()) is not None and other[3] == key:  # a count that came back is there twice
                heapq.heappop(heap)
            own = {key >> 32, key & 0xFFFFFFFF}
            if used and (own & used or other is not None and other[0] == n):
                heapq.heappush(heap, best)
                break
            fresh = left + right not in vocabulary
            vocabulary.add_rule(left, right)
            changes += part.merge(*vocabulary.rules[-1])
            used |= own
            if not fresh or left == right:
                break
        if not used:
            break
