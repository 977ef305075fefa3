"""LM scoring with an n-gram model in Elias-Fano tries.

Tokens are the words of the text in lower case (A-Z only), then one end token.
Counts come from all training rows. The model interpolates every order with the one below
(a Dirichlet prior of weight ``prior``) down to additive smoothing of single words:

    p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
    pk(w | u) = (c(uw) + prior * p(k-1)(w | shorter u)) / (c(u) + prior)

One round of ``exchange`` per order: a group sends its distinct k-grams with its training counts, and with
what the order below answered for them (lower probability, context count). A bucket holds a shard of the
k-grams - by a hash of the whole k-gram, so a frequent context is spread over all shards - builds a trie of
contexts and words from those seen in training and answers with quantised probabilities.

The trie: sorted context symbols and, per context, sorted word symbols, each an Elias-Fano sequence; the
pointers from contexts to their words are a third one, being monotone; smoothed probabilities are 16-bit codes
of log10, over the range that the corpus' own totals allow (``depth``), so that none is clipped.
Levels are written to one file in the task's scratch folder and memory-mapped. A query finds its context, reads the
pointer range, and looks for the successor of (context, word) in it. Symbols are 24-bit
hashes; with the shard, two k-grams are taken for one with a chance of about 2^-54.

Defined results: null text is empty, one end token; a null doc_id counts as
training; repeated rows count repeatedly; with no training row N and V are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logscope.llm import exchange as X
from logscope.llm import textnp as T

START = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
ADD = 0.1
GROUP = 4 << 20  # text bytes of a group: the larger, the fewer repeated k-grams travel


# --- Elias-Fano sequences ---------------------------------------------------------------------


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary. ``arrays`` are plain, so they can be
    written to a file and mapped."""

    def __init__(self, n: int, low_bits: int, arrays: list[np.ndarray]):
        self.n, self.low_bits = n, low_bits
        self.arrays = arrays
        self.low, self.high, self.ones = arrays

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        l = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros((n * l + 63) // 64 + 2, np.uint64)
        if l and n:
            v = values & T.U64((1 << l) - 1)
            bit = np.arange(n, dtype=np.uint64) * T.U64(l)
            word, shift = (bit >> T.U64(6)).astype(np.int64), bit & T.U64(63)
            np.bitwise_or.at(low, word, v << shift)
            over = np.flatnonzero(shift + T.U64(l) > T.U64(64))
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (T.U64(64) - shift[over]))
        place = (values >> T.U64(l)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, place >> 6, T.U64(1) << (place & 63).astype(np.uint64))
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return EliasFano(n, l, [low, high, ones])

    def _select(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th one."""
        word = np.searchsorted(self.ones, i, "right") - 1
        x, left = self.high[word].copy(), (i - self.ones[word]).astype(np.uint64)
        at = np.zeros(len(i), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(x & T.U64((1 << width) - 1)).astype(np.uint64)
            go = left >= part
            left = np.where(go, left - part, left)
            at += np.where(go, T.U64(width), T.U64(0))
            x = np.where(go, x >> T.U64(width), x)
        return word * 64 + at.astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i) - i).astype(np.uint64) << T.U64(self.low_bits)
        if not self.low_bits:
            return high
        bit = i.astype(np.uint64) * T.U64(self.low_bits)
        word, shift = (bit >> T.U64(6)).astype(np.int64), bit & T.U64(63)
        low = self.low[word] >> shift
        low |= np.where(shift > 0, self.low[word + 1] << ((T.U64(64) - shift) & T.U64(63)), T.U64(0))
        return high | (low & T.U64((1 << self.low_bits) - 1))

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose value is at least x, else hi."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) // 2
            less = self[mid] < x[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)


class Trie:
    """Contexts, pointers and words of one shard, with one code per (context, word)."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, folder: str):
        ctx, word = keys >> T.U64(24), keys & T.U64(0xFFFFFF)
        first, _ = T.runs(ctx)
        levels = [EliasFano.build(ctx[first], 1 << 24), EliasFano.build(np.append(first, len(keys)), len(keys) + 1)]
        index = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        # relative to its context a word symbol is monotone; over all contexts it is made so by the context's number
        levels.append(EliasFano.build((index.astype(np.uint64) << T.U64(24)) | word, max(1, len(first)) << 24))
        path = os.path.join(folder, "levels")
        arrays = [a for level in levels for a in level.arrays] + [codes.astype(np.uint16)]
        with open(path, "wb") as f:
            places = []
            for a in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                places.append(f.tell())
                f.write(a.tobytes())
        mapped = [np.memmap(path, a.dtype, "r", p, a.shape) if a.size else a for a, p in zip(arrays, places, strict=True)]
        self.contexts, self.pointers, self.words = (
            EliasFano(lv.n, lv.low_bits, mapped[3 * i:3 * i + 3]) for i, lv in enumerate(levels))
        self.codes = mapped[-1]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each sorted (context, word) key is held, and its code."""
        n = self.contexts.n
        ctx, inverse = np.unique(keys >> T.U64(24), return_inverse=True)
        at = self.contexts.successor(ctx, np.zeros(len(ctx), np.int64), np.full(len(ctx), n))
        known = at < n
        known[known] = self.contexts[at[known]] == ctx[known]
        lo, hi = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64)
        lo[known] = self.pointers[at[known]].astype(np.int64)
        hi[known] = self.pointers[at[known] + 1].astype(np.int64)
        wanted = (at[inverse].astype(np.uint64) << T.U64(24)) | (keys & T.U64(0xFFFFFF))
        place = self.words.successor(wanted, lo[inverse], hi[inverse])
        held = place < hi[inverse]
        held[held] = self.words[place[held]] == wanted[held]
        codes = np.zeros(len(keys), np.uint16)
        codes[held] = self.codes[place[held]]
        return held, codes


# --- quantisation -----------------------------------------------------------------------------


def depth(n: int, v: int, most: int, order: int, prior: float) -> float:
    """Whole decades below 1 that hold every smoothed probability: an unseen word after unseen contexts as frequent as any."""
    most = max(float(most), float(code_count(count_code(np.array([most])))[0]))
    return float(max(1, math.ceil(math.log10((n + ADD * (v + 1)) / ADD) + (order - 1) * math.log10((most + prior) / prior))))


def prob_code(p: np.ndarray, lowest: float) -> np.ndarray:
    return np.round(np.clip(-np.log10(p), 0, lowest) * (65535 / lowest)).astype(np.uint16)


def code_log10(code: np.ndarray, lowest: float) -> np.ndarray:
    return code.astype(np.float64) * (-lowest / 65535)


def count_code(c: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(np.log2(c.astype(np.float64) + 1) * 6)).astype(np.uint8)


def code_count(code: np.ndarray) -> np.ndarray:
    return np.exp2(code / 6) - 1


# --- groups -----------------------------------------------------------------------------------


def tokens(tbl: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a group, ends included, and token offsets by row."""
    data, off = T.text_bytes(tbl.column("text"))
    data = T.LOWER[data]
    s, e, rows = T.words(data, off)
    h = T.span_hashes(data, s, e)
    rows = rows + np.arange(len(rows))
    out = np.full(int(rows[-1]), END, np.uint64)
    last = np.zeros(len(out), bool)
    last[rows[1:] - 1] = True
    out[~last] = h
    return out, rows


def contexts(tok: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k - 1 tokens before each token; START stands before a text."""
    place = np.arange(len(tok)) - np.repeat(rows[:-1], np.diff(rows))
    h = np.zeros(len(tok), np.uint64)
    for back in range(k - 1, 0, -1):
        before = np.full(len(tok), START, np.uint64)
        before[back:] = tok[:-back] if back else tok
        before[place < back] = START
        h = T.mix(h * T.U64(T.BASE) + before)
    return h


def held_out_rows(tbl: pa.Table, mod: int, rest: int) -> np.ndarray:
    return np.array([d is not None and zlib.crc32(str(d).encode()) % mod == rest for d in tbl.column("doc_id").to_pylist()], bool)


def _weights(tbl: pa.Table, rows: np.ndarray, split: tuple[int, int]) -> np.ndarray:
    return np.repeat(~held_out_rows(tbl, *split), np.diff(rows)).astype(np.float64)


def _first_ask(n_buckets: int, split: tuple[int, int]):
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table) -> pa.Table:
        tbl = X.in_order(tbl)
        tok, rows = tokens(tbl)
        # START is asked for like a token; its count is the number of training texts
        keys, inverse = np.unique(np.append(tok, START), return_inverse=True)
        texts = int((~held_out_rows(tbl, *split)).sum())
        counts = np.bincount(inverse, np.append(_weights(tbl, rows, split), texts), len(keys)).astype(np.int64)
        found = dict(X.by_bucket(keys, n_buckets))
        none = np.zeros(0, np.int64)
        # every bucket is asked, so that every group learns the totals of all buckets
        return X.blobs([(key[0].as_py(), b, X.pack(keys[found.get(b, none)], *X.small_counts(counts[found.get(b, none)])))
                        for b in range(n_buckets)])
    return run


def _first_answer(tbl: pa.Table) -> pa.Table:
    rows = X.each(tbl)
    parts = [X.unpack(x, np.uint64, np.uint8, np.uint32) for _, _, x in rows]
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([X.full_counts(p[1], p[2]) for p in parts]), len(keys)).astype(np.int64)
    real = keys != START
    # tokens, words, and the most frequent context of one word (START among them)
    totals = np.array([total[real].sum(), (total[real] > 0).sum(), total.max(initial=0)], np.int64)
    out, at = [], 0
    for (g, b, _), (k, _, _) in zip(rows, parts, strict=True):
        out.append((g, b, X.pack(totals, *X.small_counts(total[inverse[at:at + len(k)]]))))
        at += len(k)
    return X.blobs(out)


def _grams(tok: np.ndarray, rows: np.ndarray, k: int, n_buckets: int):
    """A group's distinct k-grams: a first place of each, the k-gram of each token, their context and word symbols,
    and the k-grams of each bucket in the order of these symbols (in which they travel)."""
    ctx = contexts(tok, rows, k)
    word = T.mix(tok)
    keys, which, inverse = np.unique(T.mix(ctx * T.U64(3) + word), return_index=True, return_inverse=True)
    c24, w24 = ctx[which] >> T.U64(40), word[which] >> T.U64(40)
    b = (keys % T.U64(n_buckets)).astype(np.int64)
    order = np.lexsort((w24, c24, b))
    first = np.searchsorted(b[order], np.arange(n_buckets + 1))
    dealt = [(i, order[first[i]:first[i + 1]]) for i in range(n_buckets) if first[i + 1] > first[i]]
    return which, inverse, c24, w24, dealt


def _told(dealt: list, answers: dict[int, list], n: int, read) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for b, at in dealt:
        out[at] = read(answers[b])
    return out


def _next_ask(k: int, n_buckets: int, split: tuple[int, int], order: int, prior: float):
    """Ask for k-grams, from the answers to (k - 1)-grams; base results of the rows travel along."""
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table, answers: pa.Table) -> pa.Table:
        g = key[0].as_py()
        if not tbl.num_rows:
            return X.blobs([])
        tbl = X.in_order(tbl)
        tok, rows = tokens(tbl)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        if k == 2:
            got = {b: X.unpack(x, np.int64, np.uint8, np.uint32) for _, b, x in X.each(answers)}
            n, v = sum(int(p[0][0]) for p in got.values()), sum(int(p[0][1]) for p in got.values())
            lowest = depth(n, v, max(int(p[0][2]) for p in got.values()), order, prior)
            keys, inverse = np.unique(np.append(tok, START), return_inverse=True)
            c = _told(X.by_bucket(keys, n_buckets), got, len(keys), lambda p: X.full_counts(p[1], p[2]))
            start, c = c[inverse[-1]], c[inverse[:-1]]
            p = (c + ADD) / (n + ADD * (v + 1))
            base = np.bincount(row, np.log10(p), len(rows) - 1)
            known = np.bincount(row, c > 0, len(rows) - 1).astype(np.int64)
            passed = X.pack(np.array([n, start], np.int64), base, known, np.array([lowest]))
            lower, before = prob_code(p, lowest), np.full(len(tok), start)
            before[1:] = c[:-1]
            before[rows[:-1]] = start
            before = count_code(before)
        else:
            rest = {b: x for _, b, x in X.each(answers)}
            passed = rest.pop(-1)
            totals, _, _, lowest = X.unpack(passed, np.int64, np.float64, np.int64, np.float64)
            lowest, texts = float(lowest[0]), count_code(totals[1:])[0]
            which, inverse, _, _, dealt = _grams(tok, rows, k - 1, n_buckets)
            got = {b: X.unpack(x, np.uint16, np.uint8) for b, x in rest.items()}
            lower = _told(dealt, got, len(which), lambda p: p[0]).astype(np.uint16)[inverse]
            c = _told(dealt, got, len(which), lambda p: p[1]).astype(np.uint8)[inverse]
            # the context of a token is the (k - 1)-gram that ends before it; a text's first has all training texts
            before = np.full(len(tok), texts, np.uint8)
            before[1:] = c[:-1]
            before[rows[:-1]] = texts
        which, inverse, c24, w24, dealt = _grams(tok, rows, k, n_buckets)
        counts = np.bincount(inverse, _weights(tbl, rows, split), len(which)).astype(np.int64)
        out = [(g, -1 - int(g % n_buckets), passed)]
        for b, at in dealt:
            gap = np.diff(c24[at], prepend=T.U64(0))  # small numbers, whose high bytes compress to nothing
            out.append((g, b, X.pack(
                *(((gap >> T.U64(s)) & T.U64(0xFF)).astype(np.uint8) for s in (0, 8, 16)),
                (w24[at] & T.U64(0xFFFF)).astype(np.uint16), (w24[at] >> T.U64(16)).astype(np.uint8),
                *X.small_counts(counts[at]), lower[which[at]], before[which[at]], np.array([lowest]))))
        return X.blobs(out)
    return run


def _next_answer(prior: float, last: bool):
    def run(tbl: pa.Table) -> pa.Table:
        out = [(g, -1, x) for g, b, x in X.each(tbl) if b < 0]
        rows = [r for r in X.each(tbl) if r[1] >= 0]
        if not rows:
            return X.blobs(out)
        parts = [X.unpack(x, np.uint8, np.uint8, np.uint8, np.uint16, np.uint8, np.uint8, np.uint32, np.uint16, np.uint8, np.float64) for _, _, x in rows]
        join = lambda i: np.concatenate([p[i] for p in parts])
        wide = lambda p, *at: sum((p[i].astype(np.uint64) << T.U64(s) for i, s in at), T.U64(0))
        ctx = np.concatenate([np.cumsum(wide(p, (0, 0), (1, 8), (2, 16)), dtype=np.uint64) for p in parts])
        word = np.concatenate([wide(p, (3, 0), (4, 16)) for p in parts])
        keys, which, inverse = np.unique((ctx << T.U64(24)) | word, return_index=True, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([X.full_counts(p[5], p[6]) for p in parts]), len(keys))
        lowest = float(parts[0][9][0])
        below, context = 10 ** code_log10(join(7)[which], lowest), code_count(join(8)[which])
        seen = count > 0
        codes = prob_code(prior * below / (context + prior), lowest)  # not in the trie: what the order below gives
        if seen.any():
            smooth = (count[seen] + prior * below[seen]) / (np.maximum(context, count)[seen] + prior)
            with tempfile.TemporaryDirectory() as folder:
                held, found = Trie(keys[seen], prob_code(smooth, lowest), folder).find(keys)
            codes = np.where(held, found, codes)
        times = count_code(count)
        at = 0
        for (g, b, _), p in zip(rows, parts, strict=True):
            i = inverse[at:at + len(p[0])]
            out.append((g, b, X.pack(codes[i], times[:0] if last else times[i])))  # the last order is no context
            at += len(p[0])
        return X.blobs(out)
    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(order: int, n_buckets: int, split: tuple[int, int]):
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table, answers: pa.Table) -> pa.Table:
        tbl = X.in_order(tbl)
        tok, rows = tokens(tbl)
        got = {b: x for _, b, x in X.each(answers)}
        n, base, known, lowest = X.unpack(got[-1], np.int64, np.float64, np.int64, np.float64) if tbl.num_rows else [np.zeros(1, np.int64)] + [np.zeros(0)] * 2 + [np.ones(1)]
        which, inverse, _, _, dealt = _grams(tok, rows, order, n_buckets)
        codes = _told(dealt, got, len(which), lambda x: X.unpack(x, np.uint16, np.uint8)[0])
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        score = np.bincount(row, code_log10(codes, float(lowest[0]))[inverse], len(rows) - 1)
        return pa.table({
            "doc_id": tbl.column("doc_id"), "held_out": held_out_rows(tbl, *split), "n_tokens": np.diff(rows).astype(np.int64),
            "n_known": known.astype(np.int64), "train_tokens": np.full(len(known), n[0], np.int64),
            "base_score": base.astype(np.float64), "score": score.astype(np.float64)})
    return run


def lm_scores(docs: DataFrame, order: int = 2, prior: float = 2.0, split: tuple[int, int] = (10, 0)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows whose crc32(doc_id as text)
    mod split[0] is split[1] are held out of training."""
    size = X.text_size(docs)
    n = X.buckets(size)
    d = X.grouped(docs, size, GROUP)
    answers = d.groupBy("_g").applyInArrow(_first_ask(n, split), X.BLOBS).groupBy("_b").applyInArrow(_first_answer, X.BLOBS)
    for k in range(2, order + 1):
        asked = d.groupBy("_g").cogroup(answers.groupBy("_g")).applyInArrow(_next_ask(k, n, split, order, prior), X.BLOBS)
        answers = asked.groupBy("_b").applyInArrow(_next_answer(prior, k == order), X.BLOBS)
    return d.groupBy("_g").cogroup(answers.groupBy("_g")).applyInArrow(_finish(order, n, split), SCHEMA)
