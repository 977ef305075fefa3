"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text's segmentations are the paths of a lattice over the pieces of a SentencePiece model. Text is cut
into *units* (a run of spaces with the word behind it; a line break ends a unit; a unit of more than
``UNIT`` bytes is cut), pieces never cross units, so the text's lattice is a chain of unit lattices and equal
units share one. Characters without a piece of their own go byte by byte, as in SentencePiece, so every
text decodes to itself.

A piece's weight is ``1 / (rank + 2)``, its rank being its place among the model's pieces by
score (byte pieces come last). Sums over the rest of a unit (backward, in logarithms) turn weights
into exact step probabilities, so a path's log probability is the sum of its steps and the whole lattice has mass 1.

Sampling is an A* search over the lattice's prefix tree under Gumbel noise. The root's
best perturbed value is a Gumbel draw; a node's best path is drawn step by step; what branches off that path
is a set of subtrees of known mass, each with a Gumbel draw truncated at its parent's value as its bound. The
subtree of the highest bound is expanded next. So the paths come out distinct, in the order of their
perturbed values: the k best of log p + Gumbel over all paths, without listing them. Only the k
highest bounds can still be emitted, and only they are kept. The (k + 1)-th
value is the threshold t of the inclusion score 1 - exp(-exp(log p - t)).

All documents of a chunk advance together in NumPy. Noise comes from a hash of (row
key, sample, place), so a row's samples depend on nothing but its key, its text and k.

Defined results: null and empty texts have one path without pieces (rank 1, log p 0, inclusion 1); a text with fewer than k paths
gives all it has; equal rows give equal samples; a null key is the key 0; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm import textnp as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = 256
PREFIXES = (3, 5, 8)
CHUNK = 1 << 20
KEEP = 1 << 20
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


class Vocabulary:
    """Pieces of a model as byte strings (its space mark as a space), with log weights."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces: list[bytes] = [b""] * n
        normal, self.byte_id = [], np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.pieces[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                normal.append(i)
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        rank = np.full(n, len(normal), np.float64)
        rank[order] = np.arange(len(order))
        self.log_weight = -np.log(rank + 2)
        size = np.array([len(self.pieces[i]) for i in normal], np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.map = np.zeros(1 << 20, bool)
        # by a hash of their first bytes: the greatest size of the pieces that begin so
        self.reach = {n: np.zeros(1 << 18, np.uint8) for n in PREFIXES}
        for n, table in self.reach.items():
            long = [i for i in normal if len(self.pieces[i]) >= n]
            begin = np.frombuffer(b"".join(self.pieces[i][:n] for i in long), np.uint8)
            h = Loads(begin).hash(np.arange(len(long)) * n, n)
            np.maximum.at(table, (h >> T.U64(46)).astype(np.int64), np.array([len(self.pieces[i]) for i in long], np.uint8))
        for n_bytes in np.unique(size):
            at = np.array(normal)[size == n_bytes]
            block = np.frombuffer(b"".join(self.pieces[i] for i in at), np.uint8)
            h = Loads(block).hash(np.arange(len(at)) * n_bytes, int(n_bytes))
            self.map[(h >> T.U64(44)).astype(np.int64)] = True
            order = np.argsort(h)
            self.by_size[int(n_bytes)] = (h[order], at[order])

    def decode(self, ids: np.ndarray) -> str:
        """The text of a path (the space that stands before every text is taken off)."""
        return b"".join(self.pieces[i] for i in ids)[1:].decode()


class Loads:
    """Hashes of short byte strings of one array, from loads of eight bytes (exact up to eight bytes)."""

    def __init__(self, data: np.ndarray):
        self.padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(data) + 1,), "<u8", buffer=self.padded.data, strides=(1,))

    def hash(self, at: np.ndarray, size: int) -> np.ndarray:
        h = self.eight[at]
        if size < 8:
            h = h & T.U64((1 << (8 * size)) - 1)
        for more in [*range(8, size - 7, 8), size - 8] if size > 8 else []:
            h = (h ^ (h >> T.U64(29))) * T.U64(0x9FB21C651E98DF25) + self.eight[at + more]
        h = (h ^ (h >> T.U64(32))) * T.U64(0xD6E8FEB86659FD93) + T.U64(size)
        return (h ^ (h >> T.U64(30))) * T.U64(0xCA5A826395121157)


class Lattice:
    """Lattices of many units laid end to end: edges by start place, with step probabilities."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, vocab: Vocabulary):
        n = len(data)
        room = (np.repeat(end, end - start) - np.arange(n)).astype(np.uint16)  # bytes to the unit's end
        loads = Loads(data)
        head = (data & 0xC0) != 0x80  # a character's first byte
        at_all, size_all, id_all = [], [], []
        single = np.zeros(n, bool)  # characters that are pieces
        char_size = 1 + (data >= 0xC0).astype(np.uint8) + (data >= 0xE0) + (data >= 0xF0)
        places = np.flatnonzero(head).astype(np.int32)
        limit = np.minimum(room[places], 255)
        for size, (hashes, ids) in vocab.by_size.items():  # sizes ascend
            open_ = limit >= size
            places, limit = places[open_], limit[open_]
            if not len(places):
                break
            h = loads.hash(places, size)
            if size in vocab.reach:  # drop places where no longer piece begins like this
                limit = np.minimum(limit, np.maximum(vocab.reach[size][(h >> T.U64(46)).astype(np.int64)], size))
            maybe = np.flatnonzero(vocab.map[(h >> T.U64(44)).astype(np.int64)])
            p, h = places[maybe], h[maybe]
            i = np.searchsorted(hashes, h)
            i[i == len(hashes)] = 0
            ok = hashes[i] == h
            p, i = p[ok], i[ok]
            at_all.append(p)
            size_all.append(np.full(len(p), size, np.int32))
            id_all.append(ids[i].astype(np.int32))
            if size <= 4:
                single[p[char_size[p] == size]] = True
        # byte pieces for all bytes of characters that are no piece
        owner = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        p = np.flatnonzero(~single[owner]).astype(np.int32)
        del owner, single, head, places, limit
        at_all.append(p)
        size_all.append(np.ones(len(p), np.int32))
        id_all.append(vocab.byte_id[data[p]].astype(np.int32))
        at = np.concatenate(at_all)
        order = np.argsort(at, kind="stable")  # a merge of sorted runs; a place's edges by size
        at, self.size, self.id = at[order], np.concatenate(size_all)[order], np.concatenate(id_all)[order]
        del order, at_all, size_all, id_all
        self.first = np.searchsorted(at, np.arange(n + 1))
        # backward sums by distance from the unit's end
        weight = vocab.log_weight[self.id]
        back = np.zeros(n + 1)
        dist = room[at]
        target = np.where(dist > self.size, at + self.size, np.int32(n))  # place n stands for a unit's end
        by_dist = np.argsort(dist, kind="stable")
        cut = np.searchsorted(dist[by_dist], np.arange(1, int(room.max(initial=0)) + 2))
        for d in range(len(cut) - 1):
            e = by_dist[cut[d]:cut[d + 1]]
            if not len(e):
                continue
            value = weight[e] + back[target[e]]
            lo, hi = T.runs(at[e])  # edges of one place are neighbours
            top = np.maximum.reduceat(value, lo)
            back[at[e[lo]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, hi - lo)), lo))
        del by_dist, dist
        self.log_p = np.minimum(weight + back[target] - back[at], 0.0)
        del weight, target, back
        p = np.exp(self.log_p)
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(-np.expm1(self.log_p))  # of all other edges of the place
        many = np.diff(self.first)
        self.log_rest[many[at] < 2] = -np.inf
        self.cum = np.cumsum(p)
        begin = self.first[at]
        self.cum -= self.cum[begin] - p[begin]  # running sums inside a place
        del p, begin
        self.cum[self.first[1:][many > 0] - 1] = 2.0  # the last edge takes what rounding leaves

    def step(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge drawn at each place by a uniform number."""
        e = self.first[place]
        go = np.flatnonzero(self.cum[e] <= u)
        while len(go):
            e[go] += 1
            go = go[self.cum[e[go]] <= u[go]]
        return e


class Store:
    """Lattices of the units met so far, end to end as in ``Lattice``: a task builds each frequent unit's lattice once,
    not once a chunk. Holds about ``KEEP`` bytes of units between chunks; beyond that the most used stay."""

    EDGES = ("size", "id", "log_p", "log_rest", "cum")

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.data = np.zeros(0, np.uint8)
        self.first = np.zeros(1, np.int64)
        empty = Lattice(self.data, np.zeros(0, np.int64), np.zeros(0, np.int64), vocab)
        for name in self.EDGES:
            setattr(self, name, getattr(empty, name))
        self.begin, self.end, self.used = (np.zeros(0, np.int64) for _ in range(3))  # by type
        self.hash, self.type_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash

    step = Lattice.step

    def trim(self) -> None:
        """Keep the most used types up to half of ``KEEP`` (between chunks only: places change)."""
        if len(self.data) <= KEEP:
            return
        order = np.argsort(-self.used, kind="stable")
        fits = np.cumsum((self.end - self.begin)[order]) <= KEEP // 2
        keep = np.sort(order[fits])
        size = (self.end - self.begin)[keep]
        places = T.spread(self.begin[keep], size)
        many = self.first[places + 1] - self.first[places]
        edges = T.spread(self.first[places], many)
        for name in self.EDGES:
            setattr(self, name, getattr(self, name)[edges])
        self.data = self.data[places]
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.end = np.cumsum(size)
        self.begin, self.used = self.end - size, self.used[keep] // 2
        name = np.full(len(order), -1)
        name[keep] = np.arange(len(keep))
        held = name[self.type_of] >= 0
        self.hash, self.type_of = self.hash[held], name[self.type_of[held]]

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Types of new units."""
        size = end - start
        types = data[T.spread(start, size)]
        stop = np.cumsum(size)
        new = Lattice(types, stop - size, stop, self.vocab)
        at, edges = len(self.data), len(self.id)
        self.data = np.concatenate([self.data, types])
        self.first = np.concatenate([self.first[:-1], new.first + edges])
        for name in self.EDGES:
            setattr(self, name, np.concatenate([getattr(self, name), getattr(new, name)]))
        first = len(self.begin)
        self.begin, self.end = np.concatenate([self.begin, stop - size + at]), np.concatenate([self.end, stop + at])
        self.used = np.concatenate([self.used, np.zeros(len(start), np.int64)])
        return np.arange(first, first + len(start))

    def types(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The type of each unit: found by hash, equal in all bytes."""
        h, which, kind, count = np.unique(T.span_hashes(data, start, end), return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        known = self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)
        found = np.zeros(len(h), np.int64)
        found[known] = self.type_of[at[known]]
        if not known.all():
            found[~known] = self.add(data, start[which[~known]], end[which[~known]])
            hashes = np.concatenate([self.hash, h[~known]])
            order = np.argsort(hashes, kind="stable")
            self.hash, self.type_of = hashes[order], np.concatenate([self.type_of, found[~known]])[order]
        self.used[found] += count
        out = found[kind]
        size = end - start
        bad = (self.end - self.begin)[out] != size
        fits = np.flatnonzero(~bad)
        whole = len(fits) == len(out) and len(out) and size.sum() == end[-1] - start[0]  # units stand end to end
        mine = data[start[0]:end[-1]] if whole else data[T.spread(start[fits], size[fits])]
        differs = mine != self.data[T.spread(self.begin[out[fits]], size[fits])]
        if differs.any():
            bad[np.unique(np.repeat(fits, size[fits])[differs])] = True
        if bad.any():  # equal hashes of unequal units
            out[bad] = self.add(data, start[bad], end[bad])
        return out


def uniform(key: np.ndarray, sample: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the row key, the sample and a place."""
    return from_state(state(key, sample), place)


def state(key: np.ndarray, sample: int) -> np.ndarray:
    return T.mix(key + T.U64(sample * GOLDEN & MASK))


def from_state(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    h = T.mix(key + place.astype(np.uint64) * T.U64(T.BASE))
    return ((h >> T.U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units; ``data`` has the leading space of every row already."""
    n = len(data)
    cut = np.zeros(n, bool)
    space = data == 32
    cut[0:1] = True
    cut[1:] = (space[1:] & ~space[:-1]) | (data[:-1] == 10)
    cut[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n) if n else start
    long = np.flatnonzero(end - start > UNIT)
    if len(long):  # cut long units between characters
        more = []
        for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True):
            p = s + UNIT
            while p < e:
                while (data[p] & 0xC0) == 0x80 and p > s:
                    p -= 1
                more.append(p)
                p += UNIT
        start = np.union1d(start, np.array(more, np.int64))
        end = np.append(start[1:], n)
    return start, end


class Sampler:
    """k samples for each row of a chunk."""

    def __init__(self, data: np.ndarray, off: np.ndarray, keys: np.ndarray, store: Store):
        rows = len(off) - 1
        padded = np.full(len(data) + rows, 32, np.uint8)  # one space before every row
        at = np.ones(len(padded), bool)
        at[off[:-1] + np.arange(rows)] = False
        padded[at] = data
        off = off + np.arange(rows + 1)
        empty = np.diff(off) == 1
        start, end = units(padded, off)
        row = np.searchsorted(off, start, "right") - 1
        keep = ~empty[row]  # an empty text has no pieces
        start, end, row = start[keep], end[keep], row[keep]
        store.trim()
        kind = store.types(padded, start, end)
        self.lattice = store
        self.begin, self.stop = store.begin[kind], store.end[kind]  # by unit
        self.row, self.rows, self.keys = row, rows, keys
        self.first_unit = np.searchsorted(row, np.arange(rows + 1))

    def draw(self, unit: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Paths from a place in each unit to its end: unit and edge of every step, in order."""
        got_unit, got_edge, step = [], [], 0
        stop, key = self.stop[unit], state(self.keys, sample)[self.row[unit]]
        offset = unit - self.first_unit[self.row[unit]]
        while len(unit):
            live = place < stop
            if not live.all():
                unit, place, stop, key, offset = unit[live], place[live], stop[live], key[live], offset[live]
                if not len(unit):
                    break
            e = self.lattice.step(place, from_state(key, (offset << 9) + step))
            got_unit.append(unit)
            got_edge.append(e)
            place = place + self.lattice.size[e]
            step += 1
        if not got_unit:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, e = np.concatenate(got_unit), np.concatenate(got_edge)
        order = np.argsort(u, kind="stable")
        return u[order], e[order]

    def samples(self, k: int):
        """Lists by rank: (rows, perturbed value, log p, path offsets, edges); and the threshold by row (nan: none left)."""
        lat, rows = self.lattice, np.arange(self.rows)
        g = -np.log(-np.log(uniform(self.keys, 0, np.full(self.rows, -1))))
        u, e = self.draw(np.arange(len(self.begin)), self.begin, 1)
        paths = [(rows, u, e, np.searchsorted(self.row[u], np.arange(self.rows + 1)))]
        emitted = [(rows, g, np.bincount(self.row[u], lat.log_p[e], self.rows))]
        # open subtrees: row, bound, sample and step they leave, edges excluded there (as a list index)
        pool = self._branches(rows, g, 1, paths[0], np.zeros(self.rows, np.int64), k)  # k - 1 more samples and the threshold
        excluded: list[tuple[int, ...]] = []
        for r in range(2, k + 1):
            best = self._best(pool)
            if not len(best):
                break
            row, bound, which, step, gone = (x[best] for x in pool)
            pool = tuple(np.delete(x, best) for x in pool)
            # the parts of the paths before the branch, the other edge, and a fresh draw behind it
            head_u, head_e, head_r, new_u, new_e = [], [], [], [], []
            place_u, place_p = [], []
            more_gone, left = [], []
            draw = uniform(self.keys[row], 1000 + r, np.full(len(row), -2))
            for w in np.unique(which):
                of = np.flatnonzero(which == w)
                _, pu, pe, cut = paths[w]
                at = cut[row[of]] + step[of]
                span = T.spread(cut[row[of]], step[of])
                head_u.append(pu[span])
                head_e.append(pe[span])
                unit, edge = pu[at], pe[at]
                place = self._place(w, paths, row[of], step[of])
                for j, i in enumerate(of.tolist()):
                    out = (int(edge[j]),) + (excluded[gone[i] - 1] if gone[i] else ())
                    lo, hi = int(lat.first[place[j]]), int(lat.first[place[j] + 1])
                    choice = [x for x in range(lo, hi) if x not in out]
                    p = np.exp(lat.log_p[choice])
                    x = float(draw[i]) * p.sum()
                    pick = choice[min(int(np.searchsorted(np.cumsum(p), x, "right")), len(choice) - 1)]
                    new_u.append(int(unit[j]))
                    new_e.append(pick)
                    head_r.append(i)
                    place_u.append(int(unit[j]))
                    place_p.append(int(place[j] + lat.size[pick]))
                    more_gone.append((pick,) + out[1:] if gone[i] else (pick,))
                    left.append(1.0 - float(np.exp(lat.log_p[list(set(out) | {pick})]).sum()) if len(choice) > 1 else 0.0)
            # everything behind: the rest of the unit, and the row's later units
            new_u, new_e = np.array(new_u, np.int64), np.array(new_e, np.int64)
            place_u, place_p = np.array(place_u, np.int64), np.array(place_p, np.int64)
            follow = self.first_unit[self.row[place_u] + 1] - place_u - 1
            later = T.spread(place_u + 1, follow)
            tail_u, tail_e = self.draw(np.concatenate([place_u, later]), np.concatenate([place_p, self.begin[later]]), r)
            pu = np.concatenate(head_u + [new_u, tail_u])
            pe = np.concatenate(head_e + [new_e, tail_e])
            part = np.repeat(np.arange(3), [sum(map(len, head_u)), len(new_u), len(tail_u)])
            order = np.lexsort((np.arange(len(pu)), part, pu))
            # inside the branching unit: old steps, the new edge, the new draw; other units are of one part
            pu, pe = pu[order], pe[order]
            cut = np.searchsorted(self.row[pu], np.arange(self.rows + 1))
            paths.append((row, pu, pe, cut))
            row_order = np.argsort(row)
            row, bound, which, step = (x[row_order] for x in (row, bound, which, step))
            log_p = np.bincount(self.row[pu], lat.log_p[pe], self.rows)[row]
            emitted.append((row, bound, log_p))
            # what is left of the subtree itself
            back = np.argsort(np.array(head_r))[row_order]
            left, more_gone = np.array(left)[back], [more_gone[i] for i in back.tolist()]
            before = self._before(which, paths, row, step)
            ok = left > 1e-15
            names = np.zeros(len(row), np.int64)
            for i in np.flatnonzero(ok).tolist():
                excluded.append(more_gone[i])
                names[i] = len(excluded)
            rest = self._bound(before[ok] + np.log(left[ok]), bound[ok], row[ok], 2000 + r, step[ok])
            pool = tuple(np.concatenate([x, y]) for x, y in zip(pool, (row[ok], rest, which[ok], step[ok], names[ok]), strict=True))
            more = self._branches(row, bound, r, paths[-1], step + 1, k - r + 1)
            pool = tuple(np.concatenate([x, y]) for x, y in zip(pool, more, strict=True))
        threshold = np.full(self.rows, np.nan)
        best = self._best(pool)
        threshold[pool[0][best]] = pool[1][best]
        return emitted, paths, threshold

    def _place(self, w: int, paths: list, row: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Type place at which a path's step starts."""
        _, pu, pe, cut = paths[w]
        at = cut[row] + step
        size = self.lattice.size[pe]
        total = np.concatenate([[0], np.cumsum(size)])
        first = np.searchsorted(pu, pu[at])  # the unit's first step
        return self.begin[pu[at]] + total[at] - total[first]

    def _before(self, which: np.ndarray, paths: list, row: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log probability of the steps before one."""
        out = np.zeros(len(row))
        for w in np.unique(which):
            of = which == w
            _, _, pe, cut = paths[w]
            total = np.concatenate([[0.0], np.cumsum(self.lattice.log_p[pe])])
            out[of] = total[cut[row[of]] + step[of]] - total[cut[row[of]]]
        return out

    def _bound(self, log_mass: np.ndarray, top: np.ndarray, row: np.ndarray, sample: int, step: np.ndarray) -> np.ndarray:
        """A Gumbel draw at log_mass, truncated at top."""
        noise = -np.log(-np.log(uniform(self.keys[row], sample, step)))
        return -np.logaddexp(-top, -(log_mass + noise))

    def _branches(self, rows: np.ndarray, top: np.ndarray, sample: int, path: tuple, since: np.ndarray, need: int):
        """Subtrees that leave a path at any step from ``since`` on; of each row the ``need`` of the highest bounds."""
        lat = self.lattice
        _, pu, pe, cut = path
        count = np.maximum(cut[rows + 1] - cut[rows] - since, 0)
        rows, top, since, count = (x[count > 0] for x in (rows, top, since, count))
        at = T.spread(cut[rows] + since, count)
        step = T.spread(since, count)
        total = np.concatenate([[0.0], np.cumsum(lat.log_p[pe])])
        noise = from_state(np.repeat(state(self.keys, 3000 + sample)[rows], count), step)
        # a truncated draw is monotone in the free one, so the highest are chosen before they are truncated
        free = total[at] + lat.log_rest[pe[at]] - np.log(-np.log(noise))
        first = np.cumsum(count) - count
        out: list[tuple] = []
        base = total[cut[rows]]
        index = np.arange(len(rows))
        for _ in range(need):
            if not len(index):
                break
            best = np.maximum.reduceat(free, first)[index] if len(first) else np.zeros(0)
            index = index[np.isfinite(best)]
            best = best[np.isfinite(best)]
            hit = np.flatnonzero(free == np.repeat(self._fill(best, index, len(rows)), count))
            at_row = np.searchsorted(first, hit, "right") - 1
            hit = hit[np.concatenate([[True], at_row[1:] != at_row[:-1]])] if len(hit) else hit
            value = -np.logaddexp(-top[index], -(best - base[index]))
            out.append((rows[index], value, np.full(len(index), sample - 1), step[hit], np.zeros(len(index), np.int64)))
            free[hit] = -np.inf
        if not out:
            return tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @staticmethod
    def _fill(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, np.inf)
        out[index] = values
        return out

    def _best(self, pool: tuple) -> np.ndarray:
        """Place in the pool of each row's highest bound."""
        order = np.lexsort((-pool[1], pool[0]))
        s, _ = T.runs(pool[0][order])
        return order[s]


SCHEMA = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, sha256 string, round_trip boolean, ids array<int>"


def chunks(size: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of about CHUNK bytes, one row at least."""
    out, lo, total = [], 0, 0
    for i, s in enumerate(size.tolist()):
        if i > lo and total + s > CHUNK:
            out.append((lo, i))
            lo, total = i, 0
        total += s
    return out + [(lo, len(size))] if len(size) else out


def _encode(model: bytes, k: int, seed: int, with_ids: bool, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model)
        store = Store(vocab)
        piece_size = np.array([len(p) for p in vocab.pieces], np.int64)
        piece_data = np.frombuffer(b"".join(vocab.pieces), np.uint8)
        piece_at = np.cumsum(piece_size) - piece_size
        for batch in batches:
            data, off = T.text_bytes(batch.column("text"))
            key = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            key = T.mix(key + T.U64(seed * GOLDEN & MASK))
            for lo, hi in chunks(np.diff(off)):
                text, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                s = Sampler(text, o, key[lo:hi], store)
                emitted, paths, threshold = s.samples(k)
                for rank, ((row, g, log_p), (_, pu, pe, cut)) in enumerate(zip(emitted, paths, strict=True), 1):
                    ids = s.lattice.id[pe].astype(np.int32)
                    raw, n = ids.tobytes(), cut[row + 1] - cut[row]
                    t = threshold[row]
                    inclusion = np.where(np.isnan(t), 1.0, -np.expm1(-np.exp(np.minimum(log_p - t, 700))))
                    digest = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(cut[row].tolist(), cut[row + 1].tolist(), strict=True)]
                    good = None
                    if check:  # decode everything and compare it with the text
                        out = piece_data[T.spread(piece_at[ids], piece_size[ids])]
                        total = np.concatenate([[0], np.cumsum(piece_size[ids])])
                        a, b = total[cut[row]], total[cut[row + 1]]
                        size = o[row + 1] - o[row]
                        fits = np.maximum(b - a - 1, 0) == size
                        bad = np.zeros(len(row), bool)
                        pick = np.flatnonzero(fits)
                        differs = out[T.spread(a[pick] + 1, size[pick])] != text[T.spread(o[row[pick]], size[pick])]
                        np.logical_or.at(bad, np.repeat(pick, size[pick])[differs], True)
                        good = pa.array(fits & ~bad)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row)).cast(pa.int64()),
                        "rank": np.full(len(row), rank, np.int32), "n_pieces": n.astype(np.int64), "log_prob": log_p, "perturbed": g,
                        "inclusion": inclusion, "sha256": digest, "round_trip": good if good is not None else pa.nulls(len(row), pa.bool_()),
                        "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(
                            ids[T.spread(cut[row], n)])) if with_ids else pa.nulls(len(row), pa.list_(pa.int32()))})
    return run


def read_model(path: str) -> bytes:
    """A vocabulary file's bytes (they go to the tasks with the function; 0.5 MB for the public one)."""
    with open(os.fspath(path), "rb") as f:
        return f.read()


def encode(docs: DataFrame, k: int = 2, seed: int = 17, model: str = MODEL, with_ids: bool = True, check: bool = True) -> DataFrame:
    """k rows per document at most: doc_id, rank, n_pieces, log_prob, perturbed, inclusion, sha256 of the ids (int32,
    little-endian), round_trip (whether the ids decode to the text), ids."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(_encode(read_model(model), k, seed, with_ids, check), SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """Texts of id lists, as a column beside the others; null ids give null."""
    raw = read_model(model)

    @F.pandas_udf("string")
    def text(lists):
        vocab = Vocabulary(raw)
        return lists.map(lambda x: None if x is None else vocab.decode(x))
    return encoded.withColumn(out, text(F.col(ids)))
