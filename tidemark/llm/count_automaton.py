"""Weighted acyclic automata that count phrases: a state per distinct prefix, its weight the number of phrases from there.

Phrases are rows of word numbers, from 1, padded with 0, in order; numbers follow the order of the words' bytes. From
sorted phrases an automaton grows as each phrase adds the states after its common prefix with the phrase before;
here that is done for all phrases at once, depth by depth. States are not shared between equal endings, as every
state holds its own weight.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import zstandard


@dataclass
class Phrases:
    """Sorted distinct phrases and a count for each."""

    words: list[bytes]
    rows: np.ndarray
    counts: np.ndarray

    def named(self) -> list[bytes]:
        words = [b"", *self.words]
        return [b" ".join(words[w] for w in r if w) for r in self.rows.tolist()]

    def part(self, a: int, b: int) -> Phrases:
        """Rows a to b with the words that they use."""
        rows = self.rows[a:b]
        used = np.unique(rows)
        used = used[used > 0]
        number = np.zeros(len(self.words) + 1, self.rows.dtype)
        number[used] = np.arange(1, len(used) + 1)
        return Phrases([self.words[w - 1] for w in used.tolist()], number[rows], self.counts[a:b])

    def first_not_below(self, phrase: tuple[bytes, ...]) -> int:
        """The first row that is not before the phrase."""
        a, b = 0, len(self.rows)
        for k, word in enumerate(phrase):
            w = bisect_left(self.words, word) + 1
            held = w <= len(self.words) and self.words[w - 1] == word
            column = self.rows[a:b, k]
            low, high = a + int(np.searchsorted(column, w)), a + int(np.searchsorted(column, w, side="right"))
            if not held or low == high:
                return low
            a, b = low, high
        return a


def numbered(phrases: Iterable[bytes], counts: Iterable[int], depth: int) -> Phrases:
    """Phrases of space-joined words, sorted; those given more than once are added up."""
    split = [p.split(b" ") for p in phrases]
    words = sorted({w for p in split for w in p})
    number = {w: k for k, w in enumerate(words, 1)}
    rows = np.zeros((len(split), depth), np.int32)
    for r, p in enumerate(split):
        rows[r, : len(p)] = [number[w] for w in p]
    return Phrases(words, *counted(rows, np.array(list(counts), np.int64), len(words)))


def counted(rows: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, their counts added up."""
    if not len(rows):
        return rows, counts
    bits, depth = max(1, words.bit_length()), rows.shape[1]
    key = rows[:, 0].astype(np.uint64)
    held = bits
    for k in range(1, depth):
        if held + bits > 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            held = int(key.max()).bit_length()
        if held + bits > 63:
            raise ValueError("too many different words or phrases in one task")
        key = (key << np.uint64(bits)) | rows[:, k].astype(np.uint64)
        held += bits
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return rows[order[first]], np.add.reduceat(counts[order], first)


def summed(parts: list[Phrases]) -> Phrases:
    """The union of automata, weights added up."""
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: k for k, w in enumerate(words, 1)}
    rows = [np.array([0, *(number[w] for w in p.words)], np.int32)[p.rows] for p in parts]
    return Phrases(words, *counted(np.concatenate(rows), np.concatenate([p.counts for p in parts]), len(words)))


def planes(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: numbers that are small mostly take less room so when compressed."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def unplaned(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


@dataclass
class Known:
    """Words in order that an automaton's bytes may name by their place; the others are spelled out."""

    words: list[bytes] = field(default_factory=list)

    @cached_property
    def place(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


NONE_KNOWN = Known()


@dataclass
class Automaton:
    """By depth, the word into each state, the state that it comes from, and its weight; states are in order."""

    words: list[bytes]
    word: list[np.ndarray]
    parent: list[np.ndarray]
    weight: list[np.ndarray]

    @classmethod
    def of(cls, phrases: Phrases) -> Automaton:
        rows, n = phrases.rows, len(phrases.rows)
        total = np.r_[0, np.cumsum(phrases.counts)]
        out = cls(phrases.words, [], [], [])
        new, state = np.zeros(n, bool), np.zeros(n, np.int64)
        new[:1] = True
        for k in range(rows.shape[1]):
            new[1:] |= rows[1:, k] != rows[:-1, k]
            start = np.flatnonzero(new)
            end = np.r_[start[1:], n]
            there = rows[start, k] > 0
            start, end = start[there], end[there]
            out.word.append(rows[start, k])
            out.parent.append(state[start])
            out.weight.append(total[end] - total[start])
            state = np.cumsum(new & (rows[:, k] > 0)) - 1
        return out

    def states(self) -> tuple[np.ndarray, np.ndarray]:
        """The phrase into every state, with its weight; not in order."""
        depth, rows, path = len(self.word), [], np.zeros((1, len(self.word)), np.int32)
        for k in range(depth):
            path = path[self.parent[k]]
            path[:, k] = self.word[k]
            rows.append(path)
        return np.concatenate(rows), np.concatenate(self.weight)

    def phrases(self) -> Phrases:
        """The phrases that it was made of, in order."""
        depth = len(self.word)
        own, size = [], [np.zeros(0, np.int64)] * depth
        for k in range(depth):
            n = len(self.weight[k])
            beyond = np.bincount(self.parent[k + 1], self.weight[k + 1], n).astype(np.int64) if k + 1 < depth else 0
            own.append(self.weight[k] - beyond)
        for k in range(depth - 1, -1, -1):
            below = np.bincount(self.parent[k + 1], size[k + 1], len(own[k])).astype(np.int64) if k + 1 < depth else 0
            size[k] = (own[k] > 0) + below
        n = int(size[0].sum()) if depth else 0
        rows, counts = np.zeros((n, depth), np.int32), np.zeros(n, np.int64)
        path, place, ends = np.zeros((1, depth), np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for k in range(depth):
            parent = self.parent[k]
            before = np.cumsum(size[k]) - size[k]
            first = np.searchsorted(parent, parent)
            place = place[parent] + ends[parent] + before - before[first]
            path = path[parent]
            path[:, k] = self.word[k]
            ends = (own[k] > 0).astype(np.int64)
            at = np.flatnonzero(ends)
            rows[place[at]] = path[at]
            counts[place[at]] = own[k][at]
        return Phrases(self.words, rows, counts)

    def compose(self, other: Phrases, weights: np.ndarray) -> np.ndarray:
        """The weight in ``weights`` (by row of ``other``) of each phrase of this automaton that ``other`` has, else 0.

        Both are walked together, a depth at a time: a state of this automaton meets the state of the same path.
        """
        that = Automaton.of(other)
        number = {w: k for k, w in enumerate(that.words, 1)}
        names = np.array([0, *(number.get(w, 0) for w in self.words)], np.int64)
        radix = len(that.words) + 1
        mine = self.phrases()
        met = np.zeros(len(mine.rows), np.int64)  # the other's state for each phrase so far
        out = np.zeros(len(mine.rows), np.int64)
        ends = np.count_nonzero(other.rows, axis=1)
        held = np.zeros(len(other.rows), np.int64)
        for k in range(mine.rows.shape[1]):
            keys = that.parent[k] * radix + that.word[k]
            going = (met >= 0) & (mine.rows[:, k] > 0)
            held = np.searchsorted(keys, held * radix + other.rows[:, k]) if k else np.searchsorted(keys, other.rows[:, 0])
            held = np.minimum(held, max(0, len(keys) - 1))
            weight = np.zeros(len(keys), np.int64)
            weight[held[ends == k + 1]] = weights[ends == k + 1]
            key = met[going] * radix + names[mine.rows[going, k]]
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            found = (keys[at] == key) & (names[mine.rows[going, k]] > 0) if len(keys) else np.zeros(len(key), bool)
            met[going] = np.where(found, at, -1)
            over = going & (np.count_nonzero(mine.rows, axis=1) == k + 1) & (met >= 0)
            out[over] = weight[met[over]]
        return out

    def to_bytes(self, known: Known = NONE_KNOWN) -> bytes:
        held = np.array([k for w in self.words if (k := known.place.get(w)) is not None], np.int64)
        rest = [w for w in self.words if w not in known.place] if len(held) < len(self.words) else []
        names = b"\xff".join(rest)
        parts = [np.array([len(self.word), len(held), len(rest), len(names), *map(len, self.word)], "<i8").tobytes(), names, planes(np.diff(held, prepend=0).astype("<u4"))]
        for word, parent, weight in zip(self.word, self.parent, self.weight):
            parts += [planes(word.astype("<u4")), planes(np.diff(parent, prepend=0).astype("<u4")), planes(weight.astype("<i8"))]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, data: bytes, known: Known = NONE_KNOWN) -> Automaton:
        data = zstandard.ZstdDecompressor().decompress(data)
        depth, held, rest, size = np.frombuffer(data, "<i8", 4).tolist()
        states = np.frombuffer(data, "<i8", depth, 32).tolist()
        at = 32 + 8 * depth
        words = data[at : at + size].split(b"\xff") if rest else []
        at += size
        words += [known.words[k] for k in np.cumsum(unplaned(data, "<u4", held, at).astype(np.int64)).tolist()]
        at += 4 * held
        out = cls(sorted(words), [], [], [])
        for n in states:
            out.word.append(unplaned(data, "<u4", n, at).astype(np.int32))
            out.parent.append(np.cumsum(unplaned(data, "<u4", n, at + 4 * n).astype(np.int64)))
            out.weight.append(unplaned(data, "<i8", n, at + 8 * n))
            at += 16 * n
        return out
