"""Phrase collocation mining with weighted acyclic automata.

Texts are read in three passes, each over all rows, in shards of about ``SHARD_BYTES`` of text within a task:

1. words: exact counts by (lang, word);
2. pairs of words: only those of two frequent words;
3. phrases of three and four words: only those whose pairs are all frequent.

A phrase is at most as frequent as any part of it, so leaving the others out loses no candidate. "Frequent" is asked of a
broadcast bitmap of hashes, of ``BITMAP_BITS`` at most: a clash lets a phrase pass that its count rejects later, so the bound
costs work, never results (at 100 TB the bitmap fills up and passes 2 and 3 send more).

A shard sorts its n-grams and cuts them at the bounds of prefix ranges (quantiles of sampled phrases; as in Spark's
range partitioning the sample only places the cuts). Each stretch becomes a count transducer, built incrementally, and
travels as one value. A range unites its transducers, folding as they stream in, and keeps what is frequent. The
counts of a candidate's parts are looked up by composing the transducer of the wanted parts with the transducer of counts, range by range.

Everything after that is DataFrame work on candidates. A word or pair in a third of all texts is one entry a shard.

Defined cases: null text is empty, null lang is ``und``; extra columns are ignored; repeated rows count as often as they
stand; an empty table gives no rows; of phrases equal in score and count the one first in UTF-8 order ranks first.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.count_automata import PAD, CountAutomaton, Union, sorted_codes, sorted_order, string_array, to_blob
from logscope.llm.textnp import BASE, LOWER, U64, mix, span_hashes, text_bytes
from logscope.operators.position import range_partitions
from logscope.session import materialise

SHARD_BYTES = 6 << 20
RANGE_BYTES = 32 << 20
LEAST_RANGES = 128
MOST_RANGES = 100_000
SAMPLE_PER_RANGE = 16
BITMAP_BITS = 28
BLOCK_ROWS = 200_000
LONGEST = 4

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


class Shard:
    """Words of some texts: lang and word codes in UTF-8 order, and the piece each word stands in."""

    def __init__(self, tbl: pa.Table) -> None:
        data, off = text_bytes(tbl.column("text"))
        inside = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True  # a row's first byte
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before &= ~edge[:-1]
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        lens = np.flatnonzero(inside & ~after) + 1 - starts
        row = np.searchsorted(off, starts, "right") - 1
        self.piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts] + row if len(starts) else np.zeros(0, np.int64)
        ends = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lens, out=ends[1:])
        flat = np.ascontiguousarray(LOWER[data][inside])
        raw = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(flat))
        self.word, self.words = sorted_codes(raw)
        lang, self.langs = sorted_codes(string_array(tbl.column("lang").combine_chunks()))
        self.lang = lang[row] if len(starts) else np.zeros(0, np.int64)
        self.word_hash = hashes(self.words)
        self.lang_hash = hashes(self.langs)

    def __len__(self) -> int:
        return len(self.word)

    def together(self, k: int) -> np.ndarray:
        """Places whose k words stand in one piece."""
        n = max(0, len(self) - k + 1)
        return self.piece[:n] == self.piece[len(self) - n:]

    def phrase(self, at: int, k: int) -> str:
        return " ".join(self.words[int(w)].as_py() for w in self.word[at:at + k])


def hashes(strings: pa.Array) -> np.ndarray:
    data, off = text_bytes(strings)
    return span_hashes(data, off[:-1], off[1:])


def chain(h: np.ndarray, word_hash: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its head and its last word."""
    return mix(h * U64(BASE) + word_hash)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    held, size = [], 0
    for b in batches:
        at = 0
        lens = np.diff(text_bytes(b.column("text"))[1])
        for i, n in enumerate(lens.tolist()):
            size += n
            if size >= SHARD_BYTES:
                yield Shard(pa.Table.from_batches([*held, b.slice(at, i + 1 - at)]))
                held, size, at = [], 0, i + 1
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield Shard(pa.Table.from_batches(held))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


WORDS = "lang string, phrase string, n long, h long"


def _count_words(share: float):
    """Words of each shard with their counts, and (with count 0) phrases sampled for the range bounds."""
    def run(batches):
        for s in _shards(batches):
            if not len(s):
                continue
            width = len(s.words)
            key, n = np.unique(s.lang * width + s.word, return_counts=True)
            lang, word = key // width, key % width
            h = chain(s.lang_hash[lang], s.word_hash[word]).view(np.int64)
            for at in range(0, len(key), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(lang[part])).cast(pa.string()), s.words.take(pa.array(word[part])).cast(pa.string()),
                                                  pa.array(n[part]), pa.array(h[part])], ["lang", "phrase", "n", "h"])
            rng = np.random.default_rng(int(s.word_hash.sum() & U64(0xFFFFFFFF)))
            picked = np.flatnonzero(rng.random(len(s)) < share)
            if len(picked):
                texts = []
                for i in picked.tolist():
                    k = 1
                    while k < LONGEST and i + k < len(s) and s.piece[i + k] == s.piece[i]:
                        k += 1
                    texts.append(s.phrase(i, k)[:256])
                yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(s.lang[picked])).cast(pa.string()), pa.array(texts),
                                                  pa.array(np.zeros(len(picked), np.int64)), pa.array(np.zeros(len(picked), np.int64))], ["lang", "phrase", "n", "h"])
    return run


def _grams(s: Shard, orders: tuple[int, ...], has) -> tuple[np.ndarray, np.ndarray]:
    """A shard's distinct n-grams whose parts may be frequent (sorted padded rows of lang and word codes), and their counts."""
    one = chain(s.lang_hash[s.lang], s.word_hash[s.word])
    if orders[0] == 2:  # pairs: both words frequent
        known = has(one)
        ok = s.together(2) & known[:-1] & known[1:] if len(s) > 1 else np.zeros(0, bool)
    else:  # longer: all pairs frequent
        ok = s.together(2)
        at = np.flatnonzero(ok)
        ok[at] = has(chain(one[at], s.word_hash[s.word[at + 1]]))
    width = max(1, len(s.words))
    code, rows = s.lang * width + s.word, None  # of one word: lang and word in one number
    good = np.ones(len(s), bool)
    found, counts = [], []
    for k in range(2, max(orders) + 1):
        n = max(0, len(s) - k + 1)
        good = good[:n] & ok[k - 2:k - 2 + n]  # a head of k - 1 words, and the pair that adds the k-th
        at = np.flatnonzero(good)
        keys, *back, c = np.unique(code[at] * width + s.word[at + k - 1], return_inverse=k < max(orders), return_counts=True)
        head = keys // width
        head = np.column_stack([head // width, head % width]) if rows is None else rows[head]
        rows = np.column_stack([head, keys % width])
        if k < max(orders):
            code = np.zeros(n, np.int64)
            code[at] = back[0].ravel()
        if k in orders:
            found.append(np.pad(rows, ((0, 0), (0, LONGEST + 1 - rows.shape[1])), constant_values=PAD))
            counts.append(c)
    if len(found) == 1:
        return found[0], counts[0]
    out, weights = np.concatenate(found), np.concatenate(counts)
    order = sorted_order(out, max(width, len(s.langs)))
    return out[order], weights[order]


def _membership(bits: bytes):
    """Whether hashes may be in a bitmap of 2^k bits."""
    table = np.frombuffer(bits, np.uint8)
    mask = U64(len(table) * 8 - 1)

    def has(h: np.ndarray) -> np.ndarray:
        p = h & mask
        return (table[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1
    return has


def _transducers(orders: tuple[int, ...], bitmap, bounds):
    """Each shard's n-grams as one count transducer for each prefix range that it has any of."""
    def run(batches):
        has = _membership(bitmap.value)
        cuts = bounds.value
        for s in _shards(batches):
            rows, weights = _grams(s, orders, has)
            if not len(rows):
                continue

            def key(i, rows=rows, s=s):
                return (s.langs[int(rows[i, 0])].as_py(), *(s.words[int(w)].as_py() for w in rows[i, 1:] if w != PAD))
            places = [0, *(bisect.bisect_left(range(len(rows)), c, key=key) for c in cuts), len(rows)]
            out, size = [], 0
            for r, (a, b) in enumerate(zip(places, places[1:], strict=False)):
                if b > a:
                    out.append((r, to_blob(rows[a:b], weights[a:b], s.langs, s.words)))
                    size += len(out[-1][1])
                    if size > (8 << 20):
                        yield _blobs(out)
                        out, size = [], 0
            if out:
                yield _blobs(out)
    return run


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["r", "x"])


FOUND = "lang string, phrase string, k int, n long, h long"


def _unite(min_count: int):
    """The frequent n-grams of each range, from the union of its transducers (which come one range after the other)."""
    def rows_of(u: Union):
        rows, weights, langs, words = u.result()
        at = np.flatnonzero(weights >= min_count)
        rows, weights = rows[at], weights[at]
        if not len(rows):
            return
        word_hash, lang_hash = hashes(words), hashes(langs)
        h = lang_hash[rows[:, 0]]
        k = np.zeros(len(rows), np.int64)
        phrases = None
        for c in range(1, rows.shape[1]):
            has = rows[:, c] != PAD
            h = np.where(has, chain(h, word_hash[np.maximum(rows[:, c], 0)]), h)
            k += has
        texts = words.to_pylist()
        phrases = [" ".join(texts[w] for w in row if w != PAD) for row in rows[:, 1:].tolist()]
        for a in range(0, len(rows), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(rows[part, 0])).cast(pa.string()), pa.array(phrases[part], pa.string()),
                                              pa.array(k[part].astype(np.int32)), pa.array(weights[part]), pa.array(h[part].view(np.int64))],
                                             ["lang", "phrase", "k", "n", "h"])

    def run(batches):
        now, union = None, None
        for b in batches:
            for r, x in zip(b.column("r").to_pylist(), b.column("x"), strict=True):
                if r != now:
                    if union:
                        yield from rows_of(union)
                    now, union = r, Union(LONGEST + 1)
                union.add(x.as_py())
        if union:
            yield from rows_of(union)
    return run


def _bitmap(found: DataFrame) -> bytes:
    """A bitmap of the hashes: 32 bits for each, 2^BITMAP_BITS at most (32 MB on the driver and in each executor)."""
    spark = found.sparkSession
    n = found.count()
    bits = min(BITMAP_BITS, max(16, int(32 * n).bit_length()))
    p = (F.col("h").bitwiseAND((1 << bits) - 1) + 1)
    blocks = found.select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in blocks.toLocalIterator():
        block = np.frombuffer(bytes(r["m"]), np.uint8)
        at = (r["b"] - 1) * 4096
        out[at:at + len(block)] = block[:len(out) - at]
    return spark.sparkContext.broadcast(out.tobytes())


def frequent_phrases(docs: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n, h) of all phrases of up to four words with at least ``min_count`` occurrences, and (lang, words) totals."""
    spark = docs.sparkSession
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(LEAST_RANGES, size // RANGE_BYTES)))
    share = min(1.0, SAMPLE_PER_RANGE * ranges * 6 / max(size, 1))
    raw = materialise(texts.mapInArrow(_count_words(share), WORDS))
    words = materialise(raw.where("n > 0").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.max("h").alias("h")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("words"))
    sampled = sorted((r["lang"], *r["phrase"].split(" ")) for r in raw.where("n = 0").select("lang", "phrase").toLocalIterator())
    bounds = spark.sparkContext.broadcast(sorted({sampled[len(sampled) * i // ranges] for i in range(1, ranges)}) if sampled else [])
    found = words.where(F.col("n") >= min_count).select("lang", "phrase", F.lit(1).alias("k"), "n", "h")
    previous = found
    for orders in ((2,), (3, 4)):
        blobs = texts.mapInArrow(_transducers(orders, _bitmap(previous), bounds), "r int, x binary")
        previous = materialise(blobs.repartition("r").sortWithinPartitions("r").mapInArrow(_unite(min_count), FOUND))
        found = found.unionByName(previous)
    return found, totals


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (n not null) and wanted parts (n null) of a range, sorted: the counts of the wanted, by composition."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BLOCK_ROWS:
            tbl = pa.Table.from_batches(held).combine_chunks()
            last = (tbl.column("lang")[-1], tbl.column("phrase")[-1])
            cut = tbl.num_rows - 1  # rows of one phrase stay together
            while cut > 0 and (tbl.column("lang")[cut - 1], tbl.column("phrase")[cut - 1]) == last:
                cut -= 1
            if cut:
                yield from _composed(tbl.slice(0, cut))
                held, rows = tbl.slice(cut).to_batches(), tbl.num_rows - cut
    if held:
        yield from _composed(pa.Table.from_batches(held))


def _composed(tbl: pa.Table) -> Iterator[pa.RecordBatch]:
    lang, _ = sorted_codes(string_array(tbl.column("lang").combine_chunks()))
    split = [p.split(" ") for p in tbl.column("phrase").to_pylist()]
    word, _ = sorted_codes(string_array([w for p in split for w in p]))
    lens = np.array([len(p) for p in split])
    m = np.full((len(split), 1 + LONGEST), PAD, np.int64)
    m[:, 0] = lang
    m[np.repeat(np.arange(len(split)), lens), 1 + np.arange(len(word)) - np.repeat(np.cumsum(lens) - lens, lens)] = word
    n = tbl.column("n").combine_chunks()
    wanted = np.asarray(n.is_null())
    n = n.fill_null(0).to_numpy()
    sides = []
    for at in (np.flatnonzero(~wanted), np.flatnonzero(wanted)):
        at = at[sorted_order(m[at], len(tbl) + len(word))]
        sides.append((at, CountAutomaton.build(m[at], n[at])))
    (_, counts), (asked, parts) = sides
    here, there = counts.compose(parts)
    if len(here):
        got = tbl.take(pa.array(asked[there]))
        yield pa.RecordBatch.from_arrays([got.column("lang").combine_chunks(), got.column("phrase").combine_chunks(), pa.array(counts.weights[here])],
                                         ["lang", "phrase", "n"])


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, absorbed_percent: int = 80) -> DataFrame:
    """The best phrases of two to four words of each lang:
    ``(lang, rank, phrase, a, l, r, n, score)`` with a the phrase's count, l and r the counts of the two parts of its lowest-scoring
    cut, n the lang's words, score = floor(2000000 a / (l + r)). Phrases that stand in a longer candidate at least ``absorbed_percent`` % as frequent are left out."""
    found, totals = frequent_phrases(docs, min_count)
    long = found.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    cut = long.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("substring_index(phrase, ' ', c)").alias("part")),
                    F.struct(F.lit(1).alias("side"), F.expr("substring_index(phrase, ' ', c - k)").alias("part")))
    parts = cut.select("lang", "phrase", "a", "k", "c", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "c", "s.side", "s.part")
    wanted = parts.select("lang", F.col("part").alias("phrase"), F.lit(None).cast("long").alias("n")).distinct()
    both = materialise(found.select("lang", "phrase", "n").unionByName(wanted))
    counts = (both.repartitionByRange(range_partitions(both), "lang", "phrase").sortWithinPartitions("lang", "phrase")
              .mapInArrow(_look_up, "lang string, phrase string, n long"))
    counts = materialise(counts).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    known = parts.join(counts, ["lang", "part"])
    by_cut = [F.max(F.when((F.col("c") == c) & (F.col("side") == side), F.col("f"))).alias(f"f{c}{side}") for c in (1, 2, 3) for side in (0, 1)]
    wide = known.groupBy("lang", "phrase", "a", "k").agg(*by_cut)
    score = lambda c: F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(f{c}0 as decimal(20,0)) + cast(f{c}1 as decimal(20,0)))")
    cuts = F.array_compact(F.array(*[F.when(F.col(f"f{c}0").isNotNull(), F.struct(score(c).cast("long").alias("score"), F.lit(c).alias("c"), F.col(f"f{c}0").alias("l"),
                                                                                  F.col(f"f{c}1").alias("r"))) for c in (1, 2, 3)]))
    scored = wide.select("lang", "phrase", "a", "k", F.array_min(cuts).alias("_s")).select("lang", "phrase", "a", "k", "_s.score", "_s.l", "_s.r")
    # a phrase inside one two words longer is also inside the one between, which is at least as frequent
    inner = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    outer = long.where("k >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_outer"))
    wide_long = lambda c: F.col(c).cast("decimal(20,0)")
    kept = scored.join(outer, ["lang", "phrase"], "left").where(
        F.col("_outer").isNull() | (wide_long("_outer") * 100 < wide_long("a") * absorbed_percent))
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    best = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


_PIECES = r"[.,;:!?\x0A-\x0D]"
ORACLE = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '{_PIECES}')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
part AS (SELECT *, array_to_string(w[1:c], ' ') AS left_part, array_to_string(w[c + 1:k], ' ') AS right_part FROM cut),
sc AS (SELECT p.lang, p.k, p.phrase, p.a, p.c, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * p.a) // (l.a + r.a) AS BIGINT) AS score
       FROM part p JOIN f l ON l.lang = p.lang AND l.phrase = p.left_part JOIN f r ON r.lang = p.lang AND r.phrase = p.right_part),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS o FROM sc),
kept AS (SELECT * FROM best b WHERE o = 1 AND NOT EXISTS (
  SELECT 1 FROM cand x WHERE x.lang = b.lang AND x.k > b.k AND strpos(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') > 0
    AND CAST(100 AS HUGEINT) * x.a >= CAST(80 AS HUGEINT) * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN tot USING (lang) WHERE rank <= 2000
"""
