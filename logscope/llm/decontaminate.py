"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared as UTF-8 bytes in lower case (A-Z and accented Latin letters), all
white space as a space (places are kept). An item is cut into segments of ``SEGMENT``
bytes, half overlapping, so a passage that holds only a part of an item is found too. A segment of
length m matches where an alignment with at most k = rate * m edits exists. Such an alignment
keeps at least m - q + 1 - k * q of the segment's q-grams, all near one diagonal
(text place minus segment place). So:

1. q-grams of the texts are looked up in the items' q-grams (a bitmap first).
2. Hits are counted per segment and diagonal band; bands are 2k wide and start every k, so any k + 1
   neighbouring diagonals lie in one band.
3. Bands that reach the bound are verified by a banded alignment (free text ends), all together.

The items are the small side. They go to the tasks in blocks of at most
``block_bytes`` of text (a checked size); a larger benchmark takes one pass over the
documents per block, with the same result. Documents are never shuffled.

Defined results: null and empty texts and items match nothing; for short segments k is lowered until the bound is at least one
q-gram, so items of fewer than ``2 * Q`` bytes are found without edits only; items of fewer than ``Q`` bytes hold no q-gram and match the
texts that equal them;
repeated rows give repeated rows, an item that is repeated with its id counts once; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm import textnp as T
from logscope.llm.suffix_dedup import byte_grams

Q = 12
SEGMENT = 96
RATE = 0.06
STEP = 2 << 20  # text bytes looked at together
_FOLD = T.LOWER.copy()
_FOLD[0x09:0x0E] = 0x20


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the accented capitals of two bytes from 0xC3, white space as a space."""
    out = _FOLD[data]
    capital = (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)
    out[1:] += (capital * 0x20).astype(np.uint8)
    return out


class Index:
    """q-grams of the segments of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        seg_bytes, self.item, self.length, self.place = [], [], [], []
        self.short: dict[bytes, list[int]] = {}
        for item, text in items:
            data = fold(np.frombuffer((text or "").encode(), np.uint8))
            if len(data) < Q:
                if len(data):
                    self.short.setdefault(data.tobytes(), []).append(item)
                continue
            last = max(0, len(data) - SEGMENT)
            for at in sorted({*range(0, last, SEGMENT // 2), last}):
                part = data[at:at + SEGMENT]
                seg_bytes.append(np.pad(part, (0, SEGMENT - len(part))))
                self.item.append(item)
                self.length.append(len(part))
                self.place.append(at)
        self.bytes = np.array(seg_bytes, np.uint8).reshape(-1, SEGMENT)
        self.item, self.length, self.place = (np.array(x, np.int64) for x in (self.item, self.length, self.place))
        self.edits = np.maximum(0, np.minimum((RATE * self.length).astype(np.int64), (self.length - Q) // Q))
        self.needed = self.length - Q + 1 - self.edits * Q
        grams, segs, places = [], [], []
        for i, (b, n) in enumerate(zip(self.bytes, self.length, strict=True)):
            h = byte_grams(b[:n], Q)
            grams.append(h)
            segs.append(np.full(len(h), i))
            places.append(np.arange(len(h)))
        grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.first = np.append(self.first, len(grams))
        self.seg = np.concatenate(segs)[order] if segs else np.zeros(0, np.int64)
        self.at = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.map = np.zeros(1 << 24, bool)
        self.map[(grams >> T.U64(40)).astype(np.int64)] = True

    def matches(self, data: np.ndarray, off: np.ndarray):
        """Row, item, edits, start, end (bytes in the row) and segment of all verified matches in the texts. A match may be found by two
        bands and in two steps."""
        found = [self._equal(data, off)] if self.short else []
        for lo in range(0, max(1, len(data) - Q + 1), STEP):
            hi = min(len(data), lo + STEP + 3 * SEGMENT)  # regions that end past the step are whole here
            found += self._matches(data[lo:hi], lo, off)
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _equal(self, data: np.ndarray, off: np.ndarray) -> tuple:
        """The texts that equal an item without q-grams; such an item is one segment."""
        out = []
        for row in np.flatnonzero((np.diff(off) > 0) & (np.diff(off) < Q)):
            text = fold(data[off[row]:off[row + 1]])
            out += [(row, item, 0, 0, len(text), len(self.item)) for item in self.short.get(text.tobytes(), ())]
        return tuple(np.array(out, np.int64).reshape(-1, 6).T)

    def _matches(self, data: np.ndarray, base: int, off: np.ndarray) -> list[tuple]:
        if not len(self.grams):
            return []
        data = fold(data)
        h = byte_grams(data, Q)
        place = np.flatnonzero(self.map[(h >> T.U64(40)).astype(np.int64)])
        at = np.searchsorted(self.grams, h[place])
        at[at == len(self.grams)] = 0
        held = self.grams[at] == h[place]
        place, at = place[held], at[held]
        row = np.searchsorted(off, place + base, "right") - 1
        inside = place + base + Q <= off[row + 1]
        place, at, row = place[inside], at[inside], row[inside]
        many = self.first[at + 1] - self.first[at]
        entry = T.spread(self.first[at], many)
        place, row = np.repeat(place, many), np.repeat(row, many)
        seg = self.seg[entry]
        width = np.maximum(1, self.edits[seg])
        diagonal = place - self.at[entry] + SEGMENT  # never negative
        band = diagonal // width
        # every hit counts for its band and for the one that starts one width earlier
        seg, band, row, width = (np.concatenate([x, y]) for x, y in ((seg, seg), (band, band - 1), (row, row), (width, width)))
        key = (seg * (len(data) + 4 * SEGMENT) + band + 1) * 2
        order = np.lexsort((row, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        first = order[first]
        enough = count >= self.needed[seg[first]]
        first = first[enough]
        if not len(first):
            return []
        seg, row = seg[first], row[first]
        low = band[first] * width[first] - SEGMENT
        cost, start, end = self._align(data, low, width[first], seg, off[row] - base, off[row + 1] - base)
        ok = cost <= self.edits[seg]
        return [(row[ok], self.item[seg[ok]], cost[ok], (start + base - off[row])[ok], (end + base - off[row])[ok], seg[ok])]

    def _align(self, data, low, width, seg, text_lo, text_hi):
        """Least edits of each segment in a band of diagonals around [low, low + 2 * width), with free text ends."""
        reach = self.edits[seg]
        span = int((2 * width + 2 * reach).max()) + 1
        cols = np.arange(span)
        left = low - reach  # first diagonal
        scale = 1 << 12
        n = len(seg)
        # value = edits * scale + column where the alignment starts
        value = np.broadcast_to(cols, (n, span)).astype(np.int64)
        value = np.where(cols < (2 * width + 2 * reach + 1)[:, None], value, 1 << 40)
        length = self.length[seg]
        result = np.full((n, span), 1 << 40, np.int64)
        for i in range(SEGMENT):
            at = left[:, None] + cols + i
            ok = (at >= text_lo[:, None]) & (at < text_hi[:, None]) & (at >= 0) & (at < len(data))
            same = ok & (data[np.clip(at, 0, len(data) - 1)] == self.bytes[seg, i][:, None])
            new = value + np.where(same, 0, scale)  # a text byte beyond the ends equals nothing
            new[:, :-1] = np.minimum(new[:, :-1], value[:, 1:] + scale)  # segment byte left out
            new = np.minimum.accumulate(new - cols * scale, axis=1) + cols * scale  # text byte left out
            value = new
            done = length == i + 1
            result[done] = value[done]
        best = result.min(axis=1)
        column = result.argmin(axis=1)
        start = np.maximum(left + best % scale, text_lo)
        end = np.minimum(left + column + length, text_hi)
        return best // scale, start, end


FOUND = "doc_id long, item_id long, n_segments long, edits long, start long, end long"


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_bytes(batch.column("text"))
            row, item, edits, start, end, seg = index.matches(data, off)
            # one line per row and item
            order = np.lexsort((seg, item, row))
            row, item, edits, start, end, seg = (x[order] for x in (row, item, edits, start, end, seg))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
            first = np.flatnonzero(new)
            new[1:] |= seg[1:] != seg[:-1]
            if len(first):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").take(pa.array(row[first])), "item_id": item[first],
                    "n_segments": np.add.reduceat(new, first, dtype=np.int64), "edits": np.minimum.reduceat(edits, first),
                    "start": np.minimum.reduceat(start, first), "end": np.maximum.reduceat(end, first)})
    return run


def _clean(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_bytes(batch.column("text"))
            keep = np.ones(batch.num_rows, bool)
            keep[index.matches(data, off)[0]] = False
            yield batch.filter(pa.array(keep))
    return run


def indexes(items: DataFrame, block_bytes: int = 4 << 20) -> list[Index]:
    """Item indexes of at most about block_bytes of text each; the blocks are read one by one."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    return [Index([(r["item_id"], r["text"]) for r in items.where(block == b).orderBy("item_id", "text").collect()]) for b in range(blocks)]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document row and item it holds: doc_id, item_id, n_segments (distinct segments of the item), edits (the best segment's), and the
    byte range of the matches."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [d.mapInArrow(_search(x), FOUND) for x in indexes(items)]
    out = parts[0] if parts else d.limit(0).mapInArrow(_search(Index([])), FOUND)
    for p in parts[1:]:
        out = out.union(p)
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    out = docs
    for x in indexes(items):
        out = out.mapInArrow(_clean(x), out.schema)
    return out
