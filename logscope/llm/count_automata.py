"""Weighted acyclic automata over word sequences: incremental construction, union with summed weights, composition.

An automaton maps each of its sequences to a count. States with the same continuations are one state, so a state
cannot hold the count itself: each arc knows how many sequences stand before it, and the sum along a path is the rank of
its sequence in sorted order, which is its place in the array of counts (a transducer from sequences to ranks, and weights by rank).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logscope.llm.exchange import pack, unpack
from logscope.llm.textnp import spread, text_bytes

PAD = -1


def string_array(values: pa.Array | list) -> pa.LargeStringArray:
    return values.cast(pa.large_string()) if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values, pa.large_string())


def sorted_codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of strings in UTF-8 order, and the sorted distinct strings."""
    d = values.dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = d.indices.to_numpy(zero_copy_only=False)
    return (rank[codes] if len(order) else np.zeros(0, np.int64)), d.dictionary.take(pa.array(order))


class CountAutomaton:
    """The minimal automaton of sorted distinct sequences of symbols, with the count of each."""

    def __init__(self, first, label, target, skip, final, weights) -> None:
        self.first, self.label, self.target, self.skip, self.final, self.weights = first, label, target, skip, final, weights

    @classmethod
    def build(cls, rows: np.ndarray, weights: np.ndarray) -> CountAutomaton:
        """From an (n, k) matrix of symbols in lexicographic order, shorter rows padded with -1 (which sorts first).

        Incremental: a row shares the open path with the row before as far as they agree; the states behind that
        point can gain no further arc, so they are closed, from the last one, and replaced by an equal closed state if there is one."""
        n, k = rows.shape
        lengths = (rows != PAD).sum(axis=1)
        differ = np.ones((n, k + 1), bool)
        if n:
            differ[1:, :k] = rows[1:] != rows[:-1]
            differ[0, :] = True
        common = np.argmax(differ, axis=1)
        # a run: rows that differ in their last symbol only and are no head of the next row; its arcs lead to one state without arcs
        leaf = np.ones(n, bool)
        leaf[:-1] = common[1:] < lengths[:-1]
        joins = np.zeros(n, bool)
        joins[1:] = leaf[1:] & leaf[:-1] & (lengths[1:] == lengths[:-1]) & (common[1:] == lengths[1:] - 1)
        begin = np.flatnonzero(~joins)
        last = rows[np.arange(n), np.maximum(lengths - 1, 0)].tolist() if n else []
        register: dict[tuple, int] = {}
        first, label, target, skip, final, strings = [0], [], [], [], [], []

        def close(labels: list[int], targets: list[int], is_final: bool) -> int:
            key = (is_final, *labels, PAD, *targets)
            state = register.get(key)
            if state is None:
                state = register[key] = len(final)
                total = int(is_final)
                for s in targets:
                    skip.append(total)
                    total += strings[s]
                label.extend(labels)
                target.extend(targets)
                first.append(len(label))
                final.append(is_final)
                strings.append(total)
            return state

        end = close([], [], True)
        path: list[tuple[list[int], list[int]]] = [([], [])]
        ends = [False]
        heads = rows[begin].tolist()
        stops = np.append(begin[1:], n)[:len(begin)].tolist()
        for row, at, stop, length, same, is_leaf in zip(heads, begin.tolist(), stops, lengths[begin].tolist(), common[begin].tolist(), leaf[begin].tolist(), strict=True):
            while len(path) > same + 1:
                labels, targets = path.pop()
                path[-1][1].append(close(labels, targets, ends.pop()))
            for symbol in row[same:length - 1] if is_leaf else row[same:length]:
                path[-1][0].append(symbol)
                path.append(([], []))
                ends.append(False)
            if is_leaf:
                path[-1][0].extend(last[at:stop])
                path[-1][1].extend([end] * (stop - at))
            else:
                ends[-1] = True
        while len(path) > 1:
            labels, targets = path.pop()
            path[-1][1].append(close(labels, targets, ends.pop()))
        # the root stands last and is not shared
        total = int(ends[0])
        for s in path[0][1]:
            skip.append(total)
            total += strings[s]
        label.extend(path[0][0])
        target.extend(path[0][1])
        first.append(len(label))
        final.append(ends[0])
        as_int = lambda x: np.array(x, np.int32)
        return cls(as_int(first), as_int(label), as_int(target), np.array(skip, np.int64), np.array(final, np.uint8), np.asarray(weights, np.int64))

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """All sequences (padded matrix) and their counts, all paths of a depth at a time; shorter ones first."""
        state = np.array([len(self.final) - 1], np.int64)
        rank = np.zeros(1, np.int64)
        prefix = np.zeros((1, 0), np.int32)
        found = []
        while len(state):
            at = np.flatnonzero(self.final[state])
            found.append((prefix[at], rank[at]))
            lens = (self.first[state + 1] - self.first[state]).astype(np.int64)
            arcs = spread(self.first[state].astype(np.int64), lens)
            back = np.repeat(np.arange(len(state)), lens)
            prefix = np.column_stack([prefix[back], self.label[arcs]])
            rank = rank[back] + self.skip[arcs]
            state = self.target[arcs].astype(np.int64)
        width = found[-1][0].shape[1]
        rows = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1])), constant_values=PAD) for p, _ in found])
        return rows, self.weights[np.concatenate([r for _, r in found])]

    def compose(self, other: CountAutomaton) -> tuple[np.ndarray, np.ndarray]:
        """Sequences of both automata: their ranks here and there. Pairs of states are followed over common labels only."""
        a = np.array([len(self.final) - 1], np.int64)
        b = np.array([len(other.final) - 1], np.int64)
        rank_a, rank_b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        out_a, out_b = [], []
        width = int(max(self.label.max(initial=0), other.label.max(initial=0))) + 1
        while len(a):
            both = (self.final[a] & other.final[b]).astype(bool)
            out_a.append(rank_a[both])
            out_b.append(rank_b[both])
            sides = []
            for m, state in ((self, a), (other, b)):
                lens = (m.first[state + 1] - m.first[state]).astype(np.int64)
                arcs = spread(m.first[state].astype(np.int64), lens)
                back = np.repeat(np.arange(len(state)), lens)
                sides.append((arcs, back, back * width + m.label[arcs]))
            _, ia, ib = np.intersect1d(sides[0][2], sides[1][2], assume_unique=True, return_indices=True)
            arcs_a, arcs_b = sides[0][0][ia], sides[1][0][ib]
            rank_a = rank_a[sides[0][1][ia]] + self.skip[arcs_a]
            rank_b = rank_b[sides[1][1][ib]] + other.skip[arcs_b]
            a, b = self.target[arcs_a].astype(np.int64), other.target[arcs_b].astype(np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)


def _used(codes: np.ndarray, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New codes by old ones (the last entry stands for the pad), and the bytes and lengths of the strings in use."""
    flag = np.zeros(len(strings) + 1, bool)
    flag[codes] = True
    flag[-1] = False
    local = np.cumsum(flag) - 1
    local[-1] = PAD
    data, off = text_bytes(strings.take(pa.array(np.flatnonzero(flag))))
    return local, data, np.diff(off).astype(np.uint32)


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.LargeStringArray:
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(off), pa.py_buffer(data.tobytes()))


def to_blob(rows: np.ndarray, weights: np.ndarray, langs: pa.Array, words: pa.Array) -> bytes:
    """The automaton of sorted rows (lang code, word codes), with the strings its symbols stand for."""
    lang_code, *lang_text = _used(rows[:, 0], langs)
    word_code, *word_text = _used(rows[:, 1:].ravel(), words)
    m = CountAutomaton.build(np.column_stack([lang_code[rows[:, :1]], word_code[rows[:, 1:]]]), weights)
    return pack(m.first, m.label, m.target, m.skip.astype(np.uint32), m.final, m.weights, *lang_text, *word_text)


def from_blob(blob: bytes) -> tuple[CountAutomaton, pa.Array, pa.Array]:
    first, label, target, skip, final, weights, *text = unpack(
        blob, np.int32, np.int32, np.int32, np.uint32, np.uint8, np.int64, np.uint8, np.uint32, np.uint8, np.uint32)
    return CountAutomaton(first, label, target, skip.astype(np.int64), final, weights), _strings(*text[:2]), _strings(*text[2:])


def sorted_order(rows: np.ndarray, width: int) -> np.ndarray:
    """Places of rows of codes below ``width`` (pads first) in lexicographic order; as many columns to one key as 63 bits hold."""
    keys, room = [], 0
    bits = max(1, int(width).bit_length())  # codes + 1, so that a pad is 0
    for c in range(rows.shape[1]):
        if (rows[:, c] == PAD).all():
            continue
        if room + bits > 63 or not keys:
            keys.append(rows[:, c].astype(np.int64) + 1)
            room = bits
        else:
            keys[-1] = (keys[-1] << bits) | (rows[:, c] + 1)
            room += bits
    if not keys:
        return np.arange(len(rows))
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


class Union:
    """The union of automata, equal sequences' counts summed. Holds distinct sequences and a bounded number of new ones."""

    def __init__(self, width: int, limit: int = 200_000) -> None:
        self.width, self.limit = width, limit
        self.langs, self.words = string_array([]), string_array([])
        self.rows, self.weights = np.zeros((0, width), np.int32), np.zeros(0, np.int64)
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, blob: bytes) -> None:
        m, langs, words = from_blob(blob)
        rows, weights = m.sequences()
        rows = np.pad(rows, ((0, 0), (0, self.width - rows.shape[1])), constant_values=PAD)
        self.new.append((rows, weights, langs, words))
        self.waiting += len(weights)
        if self.waiting >= max(self.limit, len(self.weights)):
            self._fold()

    def _fold(self) -> None:
        parts = [(self.rows, self.weights, self.langs, self.words), *self.new]
        self.new = []
        lang_codes, self.langs = sorted_codes(pa.concat_arrays([p[2] for p in parts]))
        word_codes, self.words = sorted_codes(pa.concat_arrays([p[3] for p in parts]))
        matrices, lang_at, word_at = [], 0, 0
        for rows, _, langs, words in parts:
            m = np.full(rows.shape, PAD, np.int32)
            if len(rows):
                m[:, 0] = lang_codes[lang_at:lang_at + len(langs)][rows[:, 0]]
                mine = np.append(word_codes[word_at:word_at + len(words)], PAD)
                m[:, 1:] = mine[rows[:, 1:]]  # the pad is the last entry
            matrices.append(m)
            lang_at += len(langs)
            word_at += len(words)
        rows, weights = np.concatenate(matrices), np.concatenate([p[1] for p in parts])
        del matrices, parts
        order = sorted_order(rows, max(len(self.langs), len(self.words)))
        rows, weights = rows[order], weights[order]
        if len(rows):
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            rows, weights = rows[at], np.add.reduceat(weights, at)
        self.rows, self.weights, self.new, self.waiting = rows, weights, [], 0

    def result(self) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """Sorted rows, counts, and the strings of lang and word codes."""
        self._fold()
        return self.rows, self.weights, self.langs, self.words
