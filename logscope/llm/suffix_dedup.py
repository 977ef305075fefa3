"""Suffix-array dedup: byte strings of ``length`` bytes that start in an earlier document are removed.

Every text is its UTF-8 bytes (null: empty). ``windows`` routes the candidate
windows; here a bucket sorts the suffixes that begin at them. The sort is a
mergesort whose comparisons look at no text: prefix polynomial hashes and a
binary search give the common extension of two suffixes in log(length) steps,
and one byte decides. Suffixes that come out equal over the whole length are
verified byte by byte; if a hash collision shows, that bucket is sorted again
on its bytes.

Defined results: documents are compared by doc_id, a null id counts as greater
than any other; rows with one doc_id are never earlier than each other, so none
of them removes a byte of another; texts shorter than ``length`` lose nothing;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logscope.llm import exchange as X
from logscope.llm import textnp as T
from logscope.llm import windows as W

GRAM = 16


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, 8 <= k <= 16, from two 8-byte loads each."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data.data, strides=(1,))
    h = eight[:n] * T.U64(0x9FB21C651E98DF25)
    h ^= h >> T.U64(29)
    h += eight[k - 8:k - 8 + n] * T.U64(0xD6E8FEB86659FD93)
    return T.mix(h)


class Suffixes:
    """Suffixes of one byte array, compared over at most ``limit`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = data, limit
        # prefix hashes as in Horner's rule: pre[i + 1] = pre[i] * base + byte, from sums and powers
        part = T._BYTE[data] * T._powers(T.BASE_INV, len(data))
        n = len(data)
        self.pre = np.zeros(n + 1 + 2 * limit, np.uint64)  # a probe past the limit reads padding and is not used
        np.cumsum(part, out=self.pre[1:n + 1])
        self.pre[1:n + 1] *= T._powers(T.BASE, n)
        self.steps = [1 << i for i in range(limit.bit_length() - 1, -1, -1)]

    def _equal(self, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n bytes at a and at b have one hash."""
        power = T.U64(pow(T.BASE, n, 1 << 64))
        return self.pre[a + n] - self.pre[b + n] == (self.pre[a] - self.pre[b]) * power

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b: all of it, or a binary search."""
        n = np.full(len(a), self.limit, np.int64)
        part = np.flatnonzero(~self._equal(a, b, self.limit))
        if not len(part):
            return n
        a, b = a[part], b[part]
        found = np.zeros(len(part), np.int64)
        for step in self.steps:
            same = self._equal(a, b, step) & (found + step <= self.limit)
            found += step * same
            a, b = a + step * same, b + step * same
        n[part] = found
        return n

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b."""
        n = self.common(a, b)
        whole = n >= self.limit
        at = np.minimum(n, self.limit - 1)
        return np.where(whole, or_equal, self.data[a + at] < self.data[b + at])

    def sort(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mergesort of the suffixes ``at`` inside blocks; lo and hi are the borders of each suffix's block.
        All merges of one level run together: an element's place is its own rank plus its rank in the other run."""
        at, place, run = at.copy(), np.arange(len(at)), 1
        while True:
            live = np.flatnonzero(hi - lo > run)
            if not len(live):
                return at
            q = place[live] - lo[live]
            pair = lo[live] + q // (2 * run) * (2 * run)
            left = q % (2 * run) < run
            s = np.where(left, pair + run, pair)
            e = np.minimum(np.where(left, pair + 2 * run, pair + run), hi[live])
            s = np.minimum(s, e)
            own, first = at[live], s.copy()
            while True:
                open_ = np.flatnonzero(s < e)
                if not len(open_):
                    break
                mid = (s[open_] + e[open_]) // 2
                # equal suffixes: those of the left run come first
                less = self.before(at[mid], own[open_], ~left[open_])
                s[open_] = np.where(less, mid + 1, s[open_])
                e[open_] = np.where(less, e[open_], mid)
            new = pair + np.where(left, q % (2 * run), q % (2 * run) - run) + (s - first)
            at[new] = own
            run *= 2

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for i in range(self.limit):
            same &= self.data[a + i] == self.data[b + i]
        return same


def sorted_minima(limit: int):
    """For each window the least key of a content that holds it, by sorting the suffixes at the windows."""
    def minima(data: np.ndarray, length: np.ndarray, h: np.ndarray, aoff: np.ndarray, key: np.ndarray) -> np.ndarray:
        n = length - limit + 1
        own = np.repeat(np.arange(len(length)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(length) - length, n) + place
        least = key[own].copy()
        # equal windows have one anchor at one distance: only those are compared
        block = T.mix(h[own] + (place - aoff[own]).astype(np.uint64) * T.U64(T.BASE))
        order = np.argsort(block, kind="stable")
        lo, hi = T.runs(block[order])
        many = hi - lo > 1
        pick = order[T.spread(lo[many], (hi - lo)[many])]
        if not len(pick):
            return least
        sizes = (hi - lo)[many]
        ends = np.cumsum(sizes)
        lo, hi = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        suffixes = Suffixes(data, limit)
        # the sort moves text places; windows are found again by their place
        window_at = np.full(len(data), -1, np.int64)
        window_at[at[pick]] = pick
        done = suffixes.sort(at[pick], lo, hi)
        same = np.zeros(len(done), bool)
        same[1:] = (lo[1:] == lo[:-1]) & suffixes._equal(done[1:], done[:-1], limit)
        pairs = np.flatnonzero(same)
        if not suffixes.equal_bytes(done[pairs], done[pairs - 1]).all():  # a collision: sort on the bytes themselves
            rows = data[done[:, None] + np.arange(limit)]
            _, cls = np.unique(rows, axis=0, return_inverse=True)
            cls = cls.astype(np.int64) * (len(done) + 1) + lo
            order = np.argsort(cls, kind="stable")
            done, cls = done[order], cls[order]
            same[1:] = cls[1:] == cls[:-1]
        w = window_at[done]
        first = np.flatnonzero(~same)
        low = np.minimum.reduceat(key[own[w]], first)
        least[w] = np.repeat(low, np.diff(np.append(first, len(w))))
        return least
    return minima


def byte_windows(length: int) -> W.Windows:
    return W.Windows(size=length, gram=min(GRAM, length), tokens=lambda tbl: T.text_bytes(tbl.column("text")), grams=byte_grams,
                     same_document=False, encode=lambda t: [t], decode=lambda t: t, wire=(np.uint8,), minima=sorted_minima(length))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(length: int, keep_text: bool):
    def run(tbl: pa.Table, row: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
        data, off = T.text_bytes(tbl.column("text"))
        gone = T.covered(off[row] + s, off[row] + e + length - 1, len(data))
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        begin[inner] = gone[inner]
        count = lambda f: np.diff(np.concatenate([[0], np.cumsum(f)])[off])
        removed, spans = count(gone), count(begin)
        left = data[~gone].tobytes()
        cut = off - np.concatenate([[0], np.cumsum(removed)])
        kept = [left[cut[i]:cut[i + 1]] for i in range(len(cut) - 1)]
        return pa.table({
            "doc_id": tbl.column("doc_id"), "n_bytes": np.diff(off), "n_removed": removed.astype(np.int64), "n_spans": spans.astype(np.int64),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            "kept": pa.array(kept if keep_text else [None] * len(kept), pa.binary())})
    return run


def suffix_dedup(docs: DataFrame, length: int = 50, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes that stay
    (they may end inside a character; null without ``keep_text``)."""
    return W.repeats(docs, byte_windows(length), _finish(length, keep_text), SCHEMA)
