"""Weighted acyclic automata over words, for counts of word n-grams (one to three words).

A path from the root spells an n-gram; the weight of its last arc is the n-gram's count (0: only the beginning of a longer
one). Arcs stand in one array by state, sorted by label within a state. Building takes sorted n-grams: as soon as the
n-grams of a prefix have passed, its state is complete and shared with an equal one in the register, so equal
continuations with equal counts are stored once. Union enumerates automata in order and adds (or maximises) weights;
composition walks two automata together, level by level, along their common paths.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np

WORDS = 3


class Grams:
    """Sorted different n-grams: ``words`` (sorted bytes), ids by position (-1 behind the end), weights."""

    def __init__(self, words: list[bytes], ids: np.ndarray, weights: np.ndarray) -> None:
        self.words, self.ids, self.weights = words, ids, weights

    def __len__(self) -> int:
        return len(self.weights)

    @staticmethod
    def of(words: list[bytes], ids: np.ndarray, weights: np.ndarray, combine: np.ufunc = np.add, closed: bool = False) -> Grams:
        """From n-grams in any order, also repeated; ``closed``: every beginning of an n-gram is among them."""
        if not closed:
            heads = [ids[ids[:, 1] >= 0] * [1, 0, 0] - [0, 1, 1], np.where([True, True, False], ids[ids[:, 2] >= 0], -1)]
            ids = np.concatenate([ids, *heads])
            weights = np.concatenate([weights, np.zeros(len(ids) - len(weights), np.int64)])
        base = len(words) + 1
        if base**WORDS < 2**63:
            key = ((ids[:, 0] + 1) * base + ids[:, 1] + 1) * base + ids[:, 2] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        else:
            order = np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0]))
            rows = ids[order]
            new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])[: len(rows)])
        if not len(new):
            return Grams(words, ids[:0], weights[:0])
        return Grams(words, ids[order[new]], combine.reduceat(weights[order], new))

    def slice(self, start: int, end: int) -> Grams:
        """The n-grams from one place to another, with the words they use and the beginnings that the first one needs."""
        ids, weights = self.ids[start:end], self.weights[start:end]
        if end > start:
            lead = np.array([np.where(np.arange(WORDS) < n, ids[0], -1) for n in range(1, int((ids[0] >= 0).sum()))], np.int64).reshape(-1, WORDS)
            ids, weights = np.concatenate([lead, ids]), np.concatenate([np.zeros(len(lead), np.int64), weights])
        words, ids = self._used(ids)
        return Grams(words, ids, weights)

    def _used(self, ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The words of some rows, and the rows in places among them."""
        seen = np.zeros(len(self.words) + 1, np.int64)
        seen[ids.ravel()] = 1
        used = np.flatnonzero(seen[:-1])
        place = np.append(np.cumsum(seen[:-1]) - 1, -1)
        return [self.words[i] for i in used.tolist()], place[ids]

    def at_least(self, weight: int) -> Grams:
        keep = self.weights >= weight
        words, ids = self._used(self.ids[keep])
        return Grams.of(words, ids, self.weights[keep])

    def places(self, prefixes: list[tuple[bytes, bytes]]) -> list[int]:
        """Of each (first word, second word or empty): the place of the first n-gram that doesn't come before it."""
        base = len(self.words) + 1
        heads = self.ids[:, 0] * base + self.ids[:, 1] + 1
        out = []
        for first, second in prefixes:
            i = bisect_left(self.words, first)
            key = i * base
            if second and i < len(self.words) and self.words[i] == first:
                key += bisect_left(self.words, second) + 1
            out.append(key)
        return np.searchsorted(heads, np.array(out, np.int64)).tolist()


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the runs [start, end), one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum())) if len(sizes) else np.zeros(0, np.int64)


class Automaton:
    """``first``: where the arcs of each state begin; the last state is the root, state 0 has no arcs."""

    def __init__(self, words: list[bytes], first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> None:
        self.words, self.first, self.label, self.weight, self.target = words, first, label, weight, target

    @staticmethod
    def build(grams: Grams) -> Automaton:
        ids, weights = grams.ids, grams.weights
        one, two, three = ids[:, 1] < 0, (ids[:, 1] >= 0) & (ids[:, 2] < 0), ids[:, 2] >= 0
        # N-grams are sorted, so those behind each beginning are neighbours; here is where they end.
        pairs = np.append(np.cumsum(two)[np.flatnonzero(one)[1:]], two.sum())[: one.sum()]
        triples = np.append(np.cumsum(three)[np.flatnonzero(two)[1:]], three.sum())[: two.sum()]
        arcs: list[tuple[np.ndarray, ...]] = []
        sizes = [0]
        register: dict[bytes, int] = {b"": 0}

        def states(label: np.ndarray, weight: np.ndarray, target: np.ndarray, ends: np.ndarray) -> np.ndarray:
            """The state of each run of arcs that ends there; a run whose equal is registered gets that one's state."""
            starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
            data = np.column_stack([label, weight, target]).astype("<i8").tobytes()
            found, fresh, n = [], [], len(register)
            for start, end in zip((24 * starts).tolist(), (24 * ends).tolist(), strict=True):
                state = register.setdefault(data[start:end], n)
                if state == n:
                    fresh.append(len(found))
                    n += 1
                found.append(state)
            new = np.array(fresh, np.int64)
            places = _runs(starts[new], ends[new])
            arcs.append((label[places], weight[places], target[places]))
            sizes.extend((ends[new] - starts[new]).tolist())
            return np.array(found, np.int64)

        last = states(ids[three, 2], weights[three], np.zeros(int(three.sum()), np.int64), triples)
        middle = states(ids[two, 1], weights[two], last, pairs)
        arcs.append((ids[one, 0], weights[one], middle))
        sizes.append(int(one.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        return Automaton(grams.words, first, *(np.concatenate([a[k] for a in arcs]) for k in range(3)))

    def grams(self) -> Grams:
        """All n-grams, in order."""
        root = len(self.first) - 2
        level = np.arange(self.first[root], self.first[root + 1])
        ids = np.column_stack([self.label[level], np.full((len(level), 2), -1)])
        parts, weights = [ids], [self.weight[level]]
        for depth in (1, 2):
            state = self.target[level]
            starts, ends = self.first[state], self.first[state + 1]
            ids = np.repeat(ids, ends - starts, axis=0)
            level = _runs(starts, ends)
            ids[:, depth] = self.label[level]
            parts.append(ids)
            weights.append(self.weight[level])
        return Grams.of(self.words, np.concatenate(parts), np.concatenate(weights), closed=True)

    def encode(self) -> bytes:
        out = [len(self.first).to_bytes(4, "little"), len(self.label).to_bytes(4, "little")]
        for x in (np.diff(self.first), self.label, self.weight, self.target):
            kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
            out += [kind.char.encode(), x.astype(kind.newbyteorder("<")).tobytes()]
        return b"".join([*out, b" ".join(self.words)])

    @staticmethod
    def decode(data: bytes) -> Automaton:
        states, arcs = (int.from_bytes(data[k : k + 4], "little") for k in (0, 4))
        at, found = 8, []
        for size in (states - 1, arcs, arcs, arcs):
            kind = np.dtype(chr(data[at])).newbyteorder("<")
            found.append(np.frombuffer(data, kind, size, at + 1).astype(np.int64))
            at += 1 + size * kind.itemsize
        words = data[at:].split(b" ") if at < len(data) else []
        return Automaton(words, np.concatenate([[0], np.cumsum(found[0])]), *found[1:])


def union(automata: list[Automaton], combine: np.ufunc = np.add) -> Grams:
    """All n-grams of the automata with their weights added, or combined otherwise."""
    words = sorted(set().union(*(a.words for a in automata)))
    place = {w: i for i, w in enumerate(words)}
    ids, weights = [], []
    for a in automata:
        grams = a.grams()
        own = np.array([place[w] for w in a.words] + [-1], np.int64)  # -1 stays -1
        ids.append(own[grams.ids])
        weights.append(grams.weights)
    return Grams.of(words, np.concatenate(ids), np.concatenate(weights), combine, closed=True)


def compose(asked: Automaton, counts: Automaton, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Grams:
    """N-grams on paths of both automata, in words of the first, weighted by their two weights."""
    place = {w: i for i, w in enumerate(counts.words)}
    theirs = np.array([place.get(w, -1) for w in asked.words] or [-1], np.int64)
    base = len(counts.words) + 1
    keys = np.repeat(np.arange(len(counts.first) - 1), np.diff(counts.first)) * base + counts.label
    mine, other = np.array([len(asked.first) - 2]), np.array([len(counts.first) - 2])
    heads = np.full((1, WORDS), -1)
    ids, weights = [np.zeros((0, WORDS), np.int64)], [np.zeros(0, np.int64)]
    for depth in range(WORDS):
        starts, ends = asked.first[mine], asked.first[mine + 1]
        arcs = _runs(starts, ends)
        states = np.repeat(other, ends - starts)
        rows = np.repeat(heads, ends - starts, axis=0)
        label = theirs[asked.label[arcs]]
        at = np.searchsorted(keys, states * base + label)
        met = (label >= 0) & (np.take(keys, at, mode="clip") == states * base + label) if len(keys) else np.zeros(len(arcs), bool)
        arcs, at, heads = arcs[met], at[met], rows[met]
        heads[:, depth] = asked.label[arcs]
        ids.append(heads)
        weights.append(weigh(asked.weight[arcs], counts.weight[at]))
        mine, other = asked.target[arcs], counts.target[at]
    return Grams.of(asked.words, np.concatenate(ids), np.concatenate(weights), closed=True)
