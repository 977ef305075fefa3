"""Repeated windows of W consecutive tokens across documents, shared by the two substring operators.

Exact and without a row per window:

1. Every window has an anchor, its least K-gram by hash (leftmost of equals). Equal windows have the same
   anchor at the same place, and neighbouring windows mostly share theirs, so a text falls into *segments*:
   maximal runs of windows with one anchor.
2. An anchor alone says little: in a large corpus most K-grams come again by chance. A window reaches far to the
   left or far to the right of its anchor, so its *key* is the anchor with half of the rest of a window on that
   side; equal windows have equal keys. ``exchange`` tells each group which keys occur at least twice anywhere.
   Only windows with such a key matter; segments are cut to them.
3. Such segments go, once per group and distinct content, to the bucket of their anchor. Of one content in
   a group only the earliest occurrence is sent: its windows make those of the later ones repeats already.
   What is sent is compressed, places as differences; the anchor's hash is found again from the tokens.
4. A bucket merges equal contents and finds, for every window of the different ones, the earliest
   occurrence of that window (``minima``: the operator's own index). Windows with an earlier one return to
   their group as ranges, where they meet the documents.

Hot passages: a passage in a third of all documents is one record per group. Long documents are cut into
steps of ``STEP`` windows while anchors are found, so scratch stays bounded; cutting a segment in two
changes no result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from logscope.llm import exchange as X
from logscope.llm import textnp as T

STEP = 1 << 20
# the first byte of a value: ranges that are repeats already, or contents
KNOWN, SENT = b"\0", b"\1"


@dataclass(frozen=True)
class Windows:
    """How one operator sees texts: tokens of a table, K-gram hashes, window and K-gram length; whether an
    earlier place in the same document counts; how tokens travel; and the index that finds minima."""
    size: int
    gram: int
    tokens: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray, int], np.ndarray]
    same_document: bool
    encode: Callable[[np.ndarray], list[np.ndarray]]
    decode: Callable[..., np.ndarray]
    wire: tuple
    minima: Callable[..., np.ndarray]


def segments(w: Windows, tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, end of windows, anchor place, anchor hash."""
    parts: list[tuple] = []
    n = len(tokens) - w.size + 1
    for lo in range(0, max(n, 0), STEP):
        hi = min(n, lo + STEP)
        h = w.grams(tokens[lo:hi + w.size - 1], w.gram)
        anchor = T.sliding_argmin((h >> T.U64(32)).astype(np.uint32), w.size - w.gram + 1)
        # windows must lie inside one row
        row = np.searchsorted(off, np.arange(lo, hi), "right") - 1
        anchor = np.where(np.arange(lo, hi) + w.size <= off[row + 1], anchor, -1)
        s, e = T.runs(anchor)
        ok = anchor[s] >= 0
        s, e = s[ok], e[ok]
        a = anchor[s]
        parts.append((s + lo, e + lo, a + lo, h[a]))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def keys(w: Windows, tokens: np.ndarray, s: np.ndarray, e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment the border between windows that reach far to the left of the anchor and those that reach far
    to the right of it, and the keys of both (of a side without windows: not used)."""
    far = (w.size - w.gram + 1) // 2
    border = np.clip(a - far + 1, s, e)
    left, right = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
    on = border > s
    left[on] = T.span_hashes(tokens, a[on] - far, a[on] + w.gram)
    on = border < e
    right[on] = T.span_hashes(tokens, a[on], a[on] + w.size - far + 1)
    return border, left, right


def _asked(s: np.ndarray, e: np.ndarray, border: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The keys of all sides that have windows."""
    return np.concatenate([left[border > s], right[border < e]])


def _places(w: Windows, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The order of occurrences as one number: the document's rank, then the place in it where that counts. Equal
    places of rows that repeat a doc_id are equal, neither is the earlier one."""
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int64) << 32
    return rank + start if w.same_document else rank


def _first_map(w: Windows, n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table) -> pa.Table:
        tokens, off = w.tokens(X.opened(tbl))
        s, e, a, _ = segments(w, tokens, off)
        return X.ask_shared(key[0].as_py(), _asked(s, e, *keys(w, tokens, s, e, a)), n_buckets)[0]
    return run


def _second_map(w: Windows, n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table, answers: pa.Table) -> pa.Table:
        g = key[0].as_py()
        if not tbl.num_rows:
            return X.blobs([])
        tbl = X.opened(tbl)
        tokens, off = w.tokens(tbl)
        s, e, a, h = segments(w, tokens, off)
        border, left, right = keys(w, tokens, s, e, a)
        known = np.unique(_asked(s, e, border, left, right))
        if not len(known):
            return X.blobs([])
        known = known[X.read_shared(answers, known, n_buckets)]
        # windows whose keys occur once leave
        s, e = np.where(np.isin(left, known), s, border), np.where(np.isin(right, known), e, border)
        keep = s < e
        s, e, a, h = s[keep], e[keep], a[keep], h[keep]
        if not len(s):
            return X.blobs([])
        ends = e + w.size - 1
        content = T.mix(T.span_hashes(tokens, s, ends) ^ T.mix(h + (a - s).astype(T.U64)))
        row = np.searchsorted(off, s, "right") - 1
        doc, start = X.ids(tbl)[row], s - off[row]
        _, which, inverse = np.unique(content, return_index=True, return_inverse=True)
        earliest, order = np.full(len(which), X.LAST_ID), _places(w, doc, start)
        np.minimum.at(earliest, inverse, order)
        first = earliest[inverse] == order
        out = []
        rest = np.flatnonzero(~first)
        if len(rest):  # later occurrences are repeats already: their ranges travel on to the answers
            out.append((g, int(g % n_buckets), KNOWN + X.pack(*_ranges(row[rest], start[rest], start[rest] + (e - s)[rest]))))
        # the earliest occurrences by bucket, in the order of the text; contents in that of their first occurrence
        firsts = np.flatnonzero(first)
        for b, at in X.by_bucket(h[firsts], n_buckets):
            own = firsts[at]
            _, at, number = np.unique(inverse[own], return_index=True, return_inverse=True)
            order = np.argsort(at)
            p, number = own[at[order]], np.argsort(order)[number]
            out.append((g, b, SENT + zstandard.compress(X.pack(
                (a - s)[p].astype(np.uint16), (ends - s)[p].astype(np.uint32), X.steps(number.astype(np.uint32)),
                X.steps(row[own].astype(np.uint32)), X.steps(doc[own]), start[own].astype(np.uint32),
                *w.encode(tokens[T.spread(s[p], ends[p] - s[p])])))))
        return X.blobs(out)
    return run


def _ranges(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows by row, touching ones joined."""
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != e[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first].astype(np.uint32), s[first].astype(np.uint32), e[last].astype(np.uint32)


def _received(w: Windows, x: bytes) -> tuple[np.ndarray, ...]:
    """What a group sent: of each content the anchor's hash and place, the length; of each occurrence the number of its
    content, row, document and start; the tokens of all contents."""
    aoff, length, number, row, doc, start, *wire = X.unpack(
        zstandard.decompress(x), np.uint16, np.uint32, np.uint32, np.uint32, np.int64, np.uint32, *w.wire)
    aoff, length, tokens = aoff.astype(np.int64), length.astype(np.int64), w.decode(*wire)
    h = w.grams(tokens, w.gram)[np.cumsum(length) - length + aoff]
    return h, aoff, length, *(X.summed(v) for v in (number, row, doc)), start, tokens


def _bucket(w: Windows):
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table) -> pa.Table:
        passed, parts, groups = [], [], []
        for g, b, x in X.each(tbl):
            if x[:1] == KNOWN:
                passed.append((g, b, x[1:]))
            else:
                parts.append(_received(w, x[1:]))
                groups.append(g)
        if not parts:
            return X.blobs(passed)
        h, aoff, length, tokens = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 7))
        base = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        occ = np.concatenate([p[3].astype(np.int64) + o for p, o in zip(parts, base, strict=True)])
        row, doc, start = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (4, 5, 6))
        group = np.repeat(np.arange(len(parts)), [len(p[3]) for p in parts])
        del parts
        at = np.cumsum(length) - length

        # equal contents of different groups become one; equality is verified on the tokens
        content = T.mix(T.span_hashes(tokens, at, at + length) ^ T.mix(h + aoff.astype(T.U64)))
        _, which, inverse = np.unique(content, return_index=True, return_inverse=True)
        rep = which[inverse]
        rep = np.where((length == length[rep]) & (aoff == aoff[rep]) & (h == h[rep]), rep, np.arange(len(rep)))
        other = np.flatnonzero(rep != np.arange(len(rep)))
        if len(other):
            same = tokens[T.spread(at[other], length[other])] == tokens[T.spread(at[rep[other]], length[other])]
            same = np.logical_and.reduceat(same, np.cumsum(length[other]) - length[other])
            rep[other[~same]] = other[~same]

        rank = _places(w, doc, start)
        earliest = np.full(len(h), X.LAST_ID)
        np.minimum.at(earliest, rep[occ], rank)

        # only anchors with several different contents can hide an earlier window
        distinct = np.flatnonzero(rep == np.arange(len(rep)))
        keys, kinv, kcount = np.unique(h[distinct], return_inverse=True, return_counts=True)
        among = distinct[kcount[kinv] > 1]
        masks_s, masks_e, masks_of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(among):
            n_win = length[among] - w.size + 1
            least = w.minima(tokens[T.spread(at[among], length[among])], length[among], h[among], aoff[among], earliest[among])
            own = np.repeat(np.arange(len(among)), n_win)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
            # a window starts ``place`` tokens after its segment
            hit = least < earliest[among][own] + (place if w.same_document else 0)
            # runs of hits inside each content
            begin = hit & ~(np.concatenate([[False], hit[:-1]]) & (place > 0))
            stop = hit & ~(np.concatenate([hit[1:], [False]]) & (np.concatenate([place[1:], [0]]) > 0))
            masks_s, masks_e, masks_of = place[begin], place[stop] + 1, among[own[begin]]

        r = rep[occ]
        late = rank > earliest[r]
        out_row, out_s, out_e, out_g = [row[late]], [start[late]], [start[late] + length[r[late]] - w.size + 1], [group[late]]
        if len(masks_of):
            first = np.flatnonzero(~late)
            lo, hi = np.searchsorted(masks_of, r[first]), np.searchsorted(masks_of, r[first], "right")
            pick = np.repeat(first, hi - lo)
            m = T.spread(lo, hi - lo)
            out_row.append(row[pick])
            out_s.append(start[pick] + masks_s[m])
            out_e.append(start[pick] + masks_e[m])
            out_g.append(group[pick])
        row, s, e, group = (np.concatenate(v) for v in (out_row, out_s, out_e, out_g))
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(len(groups) + 1))
        b = key[0].as_py()
        for i, g in enumerate(groups):
            p = order[cut[i]:cut[i + 1]]
            if len(p):
                passed.append((g, b, X.pack(*_ranges(row[p], s[p], e[p]))))
        return X.blobs(passed)
    return run


def read_ranges(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the group, first window and end of windows of all repeats of a group."""
    parts = [X.unpack(x, np.uint32, np.uint32, np.uint32) for _, _, x in X.each(answers)]
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))


def repeats(docs: DataFrame, w: Windows, finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``finish(rows of a group, row, first window, end of windows)`` over all groups."""
    size = X.text_size(docs)
    n = X.buckets(size)
    d = X.parcels(X.grouped(docs, size))
    asked = d.groupBy("_g").applyInArrow(_first_map(w, n), X.BLOBS)
    told = asked.groupBy("_b").applyInArrow(X.answer_shared, X.BLOBS)
    sent = d.groupBy("_g").cogroup(told.groupBy("_g")).applyInArrow(_second_map(w, n), X.BLOBS)
    found = sent.groupBy("_b").applyInArrow(_bucket(w), X.BLOBS)

    def last(key: tuple[pa.Scalar, ...], tbl: pa.Table, answers: pa.Table) -> pa.Table:
        return finish(X.opened(tbl), *read_ranges(answers))
    return d.groupBy("_g").cogroup(found.groupBy("_g")).applyInArrow(last, schema)

