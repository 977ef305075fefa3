"""Substring dedup with a compressed FM-index per shard.

Windows of ``size`` words that start earlier (smaller doc_id, or the same
document and an earlier word) are removed. ``windows`` deals the candidate
texts out to shards; a shard builds an FM-index over its different texts (BWT
in a wavelet matrix of packed bits with rank samples) and streams those texts
through it: backward search, one word at a time from the right, gives the
matching statistics up to the threshold. Where a match reaches ``size`` words its suffix
interval is reported and the earliest occurrence in it taken; then the interval
is widened to that of the match without its last word, and the stream goes on.

Defined results: a null id counts as greater than any other; repeated rows with one doc_id
are in the order of their texts but start at equal places, so equal places
remove nothing of each other; null text has no words; texts of fewer than ``size`` words lose
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logscope.llm import textnp as T
from logscope.llm import windows as W

GRAM = 5


class WaveletMatrix:
    """Rank over a sequence of small integers: one packed bit vector per bit of the alphabet, with a count
    of ones before each 64-bit word."""

    def __init__(self, seq: np.ndarray):
        self.bits = max(1, int(seq.max()).bit_length()) if len(seq) else 1
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            ones = np.zeros(len(packed) + 1, np.uint32)
            np.cumsum(np.bitwise_count(packed), out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of each symbol before lo and before hi: both relative to the symbol's own block start, third."""
        start = np.zeros(len(symbol), np.int64)
        for k in range(self.bits):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            lo1, hi1, st1 = (self._ones(k, x) for x in (lo, hi, start))
            z = self.zeros[k]
            lo = np.where(bit, z + lo1, lo - lo1)
            hi = np.where(bit, z + hi1, hi - hi1)
            start = np.where(bit, z + st1, start - st1)
        return lo - start, hi - start, start

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = self.words[k][w] & ((T.U64(1) << (i & 63).astype(np.uint64)) - T.U64(1))
        return self.ones[k][w].astype(np.int64) + np.bitwise_count(low)


class FMIndex:
    """FM-index of texts over an integer alphabet; 0 ends each text."""

    def __init__(self, seq: np.ndarray, longest: int, threshold: int):
        n = len(seq)
        rank = seq.astype(np.int64)
        t = threshold - 1
        half = 1 << max(0, t.bit_length() - 1)
        r, depth, ended = rank, 1, rank == 0
        while depth < longest:  # prefix doubling: ranks by 1, 2, 4, ... symbols; nothing is compared past a text's end
            nxt, later = np.zeros(n, np.int64), np.ones(n, bool)
            nxt[:n - depth], later[:n - depth] = rank[depth:], ended[depth:]
            nxt[ended] = 0
            _, rank = np.unique(rank * (int(rank.max()) + 1) + nxt, return_inverse=True)
            rank = rank.astype(np.int64)
            ended = ended | later
            depth *= 2
            if depth == half:
                r = rank
        self.sa = np.argsort(rank, kind="stable")
        bwt = seq[self.sa - 1]
        self.tree = WaveletMatrix(bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq))])
        self.size = n
        # rows whose suffixes agree in threshold - 1 symbols, from two overlapping power-of-two ranks
        a, b = r[self.sa], r[np.minimum(self.sa + t - half, n - 1)] if t else r[self.sa]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        begin = np.flatnonzero(new)
        block = np.cumsum(new) - 1
        self.wide_lo = begin[block]
        self.wide_hi = np.append(begin[1:], n)[block]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of symbol + match."""
        lo, hi, _ = self.tree.rank(symbol, lo, hi)
        return self.first[symbol] + lo, self.first[symbol] + hi

    def statistics(self, texts: np.ndarray, lengths: np.ndarray, threshold: int):
        """Streams texts through the index from their last symbol to their first, all side by side. Yields
        (text, place, lo, hi) wherever ``threshold`` symbols from place on match, with their suffix interval."""
        begin = np.cumsum(lengths) - lengths
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64)
        matched = np.zeros(len(lengths), np.int64)
        live = np.arange(len(lengths))
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            place = lengths[live] - 1 - step
            l, h = self.extend(texts[begin[live] + place], lo[live], hi[live])
            matched[live] += 1
            full = matched[live] >= threshold
            if full.any():
                yield live[full], place[full], l[full], h[full]
                matched[live[full]] -= 1
                l[full], h[full] = self.wide_lo[l[full]], self.wide_hi[l[full]]
            lo[live], hi[live] = l, h


def index_minima(size: int):
    """For each window the least place (a text's key plus the window's start in it) that holds it, from the shard's index."""
    def minima(tokens: np.ndarray, length: np.ndarray, h: np.ndarray, aoff: np.ndarray, key: np.ndarray) -> np.ndarray:
        _, word = np.unique(tokens, return_inverse=True)
        word = word.astype(np.int64) + 1
        begin = np.cumsum(length) - length
        seq = np.zeros(len(word) + len(length), np.int64)
        seq[np.arange(len(word)) + np.repeat(np.arange(len(length)), length)] = word
        index = FMIndex(seq, int(length.max()) + 1, size)
        text_of = np.repeat(np.arange(len(length)), length + 1)
        # a text begins after the texts before it and their separators
        row_key = key[text_of[index.sa]] + index.sa - (begin + np.arange(len(length)))[text_of[index.sa]]
        n = length - size + 1
        out_at = np.cumsum(n) - n
        found = [x for x in index.statistics(word, length, size)]
        text, place, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(4))
        spans, inverse = np.unique(lo * (index.size + 1) + hi, return_inverse=True)
        s, e = spans // (index.size + 1), spans % (index.size + 1)
        # disjoint intervals in order: the even parts of the cut array are theirs
        low = np.minimum.reduceat(np.append(row_key, np.iinfo(np.int64).max), np.stack([s, e], 1).ravel())[::2]
        least = np.empty(int(n.sum()), np.int64)
        least[out_at[text] + place] = low[inverse]
        return least
    return minima


def word_tokens(tbl: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    data, off = T.text_bytes(tbl.column("text"))
    s, e, rows = T.words(data, off)
    return T.span_hashes(data, s, e) & T.U64((1 << 48) - 1), rows


def word_windows(size: int) -> W.Windows:
    """Words travel as 48-bit hashes; two windows pass for equal only if all their hashes are."""
    return W.Windows(
        size=size, gram=min(GRAM, size), tokens=word_tokens, grams=T.ngram_hashes, same_document=True,
        encode=lambda t: [(t & T.U64(0xFFFFFFFF)).astype(np.uint32), (t >> T.U64(32)).astype(np.uint16)],
        decode=lambda lo, hi: lo.astype(np.uint64) | (hi.astype(np.uint64) << T.U64(32)), wire=(np.uint32, np.uint16),
        minima=index_minima(size))


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _finish(size: int, keep_text: bool):
    def run(tbl: pa.Table, row: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Table:
        data, off = T.text_bytes(tbl.column("text"))
        ws, we, words = T.words(data, off)
        gone = T.covered(words[row] + s, words[row] + e + size - 1, len(ws))
        stay = np.flatnonzero(~gone)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words])
        # kept words, each followed by one space
        padded = np.append(data, np.uint8(32))
        length = we[stay] - ws[stay] + 1
        text = padded[T.spread(ws[stay], length)]
        text[np.cumsum(length) - 1] = 32
        left = text.tobytes()
        cut = np.concatenate([[0], np.cumsum(length)])[words - np.concatenate([[0], np.cumsum(removed)])]
        kept = [left[a:max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table({
            "doc_id": tbl.column("doc_id"), "n_words": np.diff(words).astype(np.int64), "n_removed": removed.astype(np.int64),
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
            "kept": pa.array([k.decode() if keep_text else None for k in kept], pa.string())})
    return run


def substring_dedup(docs: DataFrame, size: int = 20, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and ``kept``, the words that stay joined by
    one space (null without ``keep_text``)."""
    return W.repeats(docs, word_windows(size), _finish(size, keep_text), SCHEMA)
