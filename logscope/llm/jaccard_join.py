"""N-gram Jaccard join with signature trees; exact, and linear in links that matter.

A document's set is its distinct ``n``-word shingles (lower-case A-Z). Two documents link when
``100 * intersection >= percent * union``.

1. Equal sets are one *class* from the start (a group of thousands of copies is one row).
2. ``exchange`` tells every group how frequent each shingle is in the corpus. Each set is put in the
   order (frequency step, hash) - the same for all sets - and linked sets must share one of the first
   ``size - ceil(percent * size / 100) + 1`` shingles (prefix filtering). Because rare shingles come
   first, a passage that a third of all documents share is not in the prefix of documents that hold
   other text besides. Shingles of one document only are left out.
3. Classes sharing a prefix shingle are joined to candidate components. Only inside such
   a component are sets compared, by a dual traversal of a *signature tree*: leaves hold
   token bitmaps, nodes the OR of theirs, the least number of set bits and the size range; a pair of nodes is
   pruned when no set below one can overlap enough with any below the other. Pairs already known to
   be connected are not compared (only components are wanted). What is left is verified on the sets.
4. A candidate component larger than ``BLOCK`` classes is cut into blocks by hash. Blocks are joined
   within themselves; then one leader of each partial component meets the other leaders, in blocks by a new hash each
   round until they fit one block, or all pairs of blocks once a round no longer halves them; then every class
   outside the candidate's largest partial component meets every block. Pairs that none of
   the steps compares are connected already, so no link between components is lost.

Nothing is capped. Shingle hashes have 64 bits. Defined results: null or empty text has an empty set and is its own
component; repeated rows are equal sets; a null doc_id takes part in links but names a
component only if no id is there; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm import exchange as X
from logscope.llm import textnp as T
from logscope.llm.components import components
from logscope.session import materialise

BLOCK = 2048
FANOUT = 8
BITS = 1024


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection that a set of this size can have with a linked one."""
    return (percent * size + 99) // 100


def shingle_sets(tbl: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and offsets by row."""
    data, off = T.text_bytes(tbl.column("text"))
    data = T.LOWER[data]
    s, e, rows = T.words(data, off)
    tok = T.span_hashes(data, s, e)
    count = np.diff(rows)
    parts_h, parts_r = [], []
    h = T.ngram_hashes(tok, n)
    at = T.spread(rows[:-1], np.maximum(count - n + 1, 0))
    parts_h.append(h[at])
    parts_r.append(np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0)))
    for m in range(1, n):  # fewer words: the whole sequence
        short = np.flatnonzero(count == m)
        parts_h.append(T.ngram_hashes(tok, m)[rows[short]] if len(short) else np.zeros(0, np.uint64))
        parts_r.append(short)
    h, r = np.concatenate(parts_h), np.concatenate(parts_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(count) + 1))


def _ask(n: int, n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table) -> pa.Table:
        h, _ = shingle_sets(X.in_order(tbl), n)
        keys, counts = np.unique(h, return_counts=True)
        g = key[0].as_py()
        return X.blobs([(g, b, X.pack((keys[at] >> T.U64(32)).astype(np.uint32), *X.small_counts(counts[at])))
                        for b, at in X.by_bucket(keys, n_buckets)])
    return run


def frequency_step(count: np.ndarray) -> np.ndarray:
    """0 for one document, then a step for each factor of sqrt(2); any function of the count alone would be right."""
    return np.minimum(255, np.round(2 * np.log2(count)) + (count > 1)).astype(np.uint8)


def _answer(tbl: pa.Table) -> pa.Table:
    rows = X.each(tbl)
    parts = [X.unpack(x, np.uint32, np.uint8, np.uint32) for _, _, x in rows]
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    step = frequency_step(np.bincount(inverse, np.concatenate([X.full_counts(p[1], p[2]) for p in parts]), len(keys)))
    out, at = [], 0
    for (g, b, _), p in zip(rows, parts, strict=True):
        out.append((g, b, X.pack(step[inverse[at:at + len(p[0])]])))
        at += len(p[0])
    return X.blobs(out)


SETS = "doc_id long, n_shingles long, node long, text_hash long, prefix array<long>, tokens binary"


def _sets(n: int, n_buckets: int, percent: int):
    def run(key: tuple[pa.Scalar, ...], tbl: pa.Table, answers: pa.Table) -> pa.Table:
        tbl = X.in_order(tbl)
        h, off = shingle_sets(tbl, n)
        size = np.diff(off)
        keys, inverse = np.unique(h, return_inverse=True)
        got = {b: X.unpack(x, np.uint8)[0] for _, b, x in X.each(answers)}
        step = np.zeros(len(keys), np.uint8)
        for b, at in X.by_bucket(keys, n_buckets):
            step[at] = got[b]
        step = step[inverse]
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((h, step, row))
        place = np.arange(len(h)) - np.repeat(off[:-1], size)
        prefix = size - least_overlap(size, percent) + 1
        use = order[(place < prefix[row]) & (step[order] > 0)]
        cut = np.searchsorted(row[use], np.arange(len(size) + 1))
        # a set's name: a hash of its sorted shingles
        node = T.mix(T.span_hashes(h, off[:-1], off[1:]) + size.astype(np.uint64)).view(np.int64)
        signed = h.view(np.int64)
        listed = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed[use]))
        _, first = np.unique(node, return_index=True)
        once = np.zeros(len(size), bool)
        once[first] = True  # a group sends one copy of a set
        tokens = [h[off[i]:off[i + 1]].tobytes() if once[i] and cut[i + 1] > cut[i] else None for i in range(len(size))]
        return pa.table({"doc_id": tbl.column("doc_id"), "n_shingles": size.astype(np.int64), "node": pa.array(node, mask=size == 0),
                         "text_hash": tbl.column("_t"), "prefix": listed, "tokens": pa.array(tokens, pa.binary())})
    return run


# --- signature trees --------------------------------------------------------------------------


class SignatureTree:
    """Token bitmaps of sets, and level by level above them the OR, the fewest set bits and the size range."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        size = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), BITS // 64), np.uint64)
        row = np.repeat(np.arange(len(sets)), size)
        bit = np.concatenate(sets) % T.U64(BITS) if len(sets) else np.zeros(0, np.uint64)
        np.bitwise_or.at(maps, (row, (bit >> T.U64(6)).astype(np.int64)), T.U64(1) << (bit & T.U64(63)))
        self.levels = [(maps, np.bitwise_count(maps).sum(1).astype(np.int64), size, size)]
        while len(self.levels[-1][0]) > 1:
            maps, few, lo, hi = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(few, at),
                                np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def candidates(self, other: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that the bounds do not rule out, by descending both trees together."""
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        x, y = len(self.levels) - 1, len(other.levels) - 1
        while True:
            ok = self._possible(other, x, y, a, b)
            a, b = a[ok], b[ok]
            if x == 0 and y == 0:
                return a, b
            if x >= y:
                a, b = self._children(x, a, b)
                x -= 1
            else:
                b, a = other._children(y, b, a)
                y -= 1
            if other is self:  # each unordered pair of subtrees once
                first, last = a * FANOUT ** x, (b + 1) * FANOUT ** y
                keep = first < last
                a, b = a[keep], b[keep]

    def _children(self, level: int, own: np.ndarray, with_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.levels[level - 1][0])
        count = np.minimum(n - own * FANOUT, FANOUT)
        return T.spread(own * FANOUT, count), np.repeat(with_, count)

    def _possible(self, other: SignatureTree, x: int, y: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        maps, few, lo, hi = self.levels[x]
        maps2, few2, lo2, hi2 = other.levels[y]
        ok = (hi[a] * 100 >= self.percent * lo2[b]) & (hi2[b] * 100 >= self.percent * lo[a])
        for part in np.array_split(np.flatnonzero(ok), max(1, len(ok) // 20000)):
            p, q = a[part], b[part]
            both = np.bitwise_count(maps[p] & maps2[q]).sum(1).astype(np.int64)
            # bits of a set that the other side lacks are shingles that it lacks
            ok[part] = (few[p] - both <= hi[p] - least_overlap(hi[p], self.percent)) & (
                few2[q] - both <= hi2[q] - least_overlap(hi2[q], self.percent))
        return ok


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The link test on two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum()) if len(a) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def join_sets(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, union: Union, shift: int) -> list[tuple[int, int]]:
    """Links of a spanning kind: pairs whose ends no earlier link connects. ``right`` None: within left."""
    tree = SignatureTree(left, percent)
    other = tree if right is None else SignatureTree(right, percent)
    a, b = tree.candidates(other)
    found = []
    # near ones first: then a family is connected after few tests
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if right is None and i >= j:
            continue
        j2 = j + shift
        if union.find(i) != union.find(j2) and linked(left[i], (left if right is None else right)[j], percent):
            union.join(i, j2)
            found.append((i, j2))
    return found


ROOTS = "node long, comp long, root long"


def _within(percent: int):
    """One call holds many small candidate components, or a block of a large one."""
    def run(tbl: pa.Table) -> pa.Table:
        node, comp = tbl.column("node").to_numpy(), tbl.column("comp").to_numpy()
        order = np.lexsort((node, comp))
        tokens = tbl.column("tokens").to_pylist()
        root = np.zeros(len(node), np.int64)
        s, e = T.runs(comp[order])
        for lo, hi in zip(s.tolist(), e.tolist(), strict=True):
            at = order[lo:hi]
            sets = [np.frombuffer(tokens[i], np.uint64) for i in at]
            by_size = np.argsort([len(x) for x in sets], kind="stable")
            union = Union(len(sets))
            join_sets([sets[i] for i in by_size], None, percent, union, 0)
            names = node[at[by_size]]
            top = np.array([union.find(i) for i in range(len(sets))])
            least = np.full(len(sets), np.iinfo(np.int64).max)
            np.minimum.at(least, top, names)
            root[at[by_size]] = least[top]
        return pa.table({"node": node, "comp": comp, "root": root})
    return run


LINKS = "u long, v long"


def _across(percent: int):
    """A block's classes against classes from outside the largest partial component: links between roots."""
    def run(tbl: pa.Table) -> pa.Table:
        root, minor = tbl.column("root").to_numpy(), np.array(tbl.column("minor").to_pylist(), bool)
        tokens = tbl.column("tokens").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in tokens]
        left, right = np.flatnonzero(~minor), np.flatnonzero(minor)
        if not len(left) or not len(right):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        at = np.concatenate([left, right])
        union = Union(len(at))
        first: dict[int, int] = {}
        for i, r in enumerate(root[at].tolist()):  # known components
            union.join(first.setdefault(r, i), i)
        found = join_sets([sets[i] for i in left], [sets[i] for i in right], percent, union, len(left))
        return pa.table({"u": pa.array([int(root[at[i]]) for i, _ in found], pa.int64()),
                         "v": pa.array([int(root[at[j]]) for _, j in found], pa.int64())})
    return run


def _leaders_met(leaders: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join all leaders of a candidate component which are linked, directly or over other leaders."""
    links, seed, before = None, 0, None
    while True:
        seed += 1
        count = leaders.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_parts"))
        # the seed makes this another hash than that of the blocks the leaders come from, and of the last round
        parted = materialise(leaders.join(count, "comp").withColumn("_part", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("_parts"))))
        n = parted.where("_parts > 1").count()
        if n and before is not None and 2 * n > before:
            break
        before = n
        keyed = parted.select(F.xxhash64("comp", "_part").alias("_k"), "node", "comp", "tokens")
        led = materialise(keyed.groupBy("_k").applyInArrow(_within(percent), ROOTS))
        new = led.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        links = new if links is None else links.union(new)
        if not n:
            return links
        leaders = parted.where("_parts > 1").join(led.where("node = root").select("node"), "node", "left_semi").select("node", "comp", "tokens")
    # leaders that stay apart: each pair of parts once (within a part as well)
    rest = parted.select(F.xxhash64("comp", "_part").alias("_k"), "node", "comp", "tokens")
    led = rest.groupBy("_k").applyInArrow(_within(percent), ROOTS).where("node <> root")
    other = parted.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).where("_other <> _part")
    pairs = other.select(F.xxhash64("comp", F.least("_part", "_other"), F.greatest("_part", "_other")).alias("_k"),
                         F.col("node").alias("root"), (F.col("_part") > F.col("_other")).alias("minor"), "tokens")
    return links.union(led.select("node", "root")).union(pairs.groupBy("_k").applyInArrow(_across(percent), LINKS))


def _labelled(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(one row per document with its set's name, one row per set's name with its component's label)."""
    size = X.text_size(docs)
    nb = X.buckets(size)
    d = X.grouped(docs, size).withColumn("_t", F.xxhash64("text"))
    told = d.groupBy("_g").applyInArrow(_ask(n, nb), X.BLOBS).groupBy("_b").applyInArrow(_answer, X.BLOBS)
    sets = materialise(d.groupBy("_g").cogroup(told.groupBy("_g")).applyInArrow(_sets(n, nb, percent), SETS))

    names = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    candidates = sets.where("tokens is not null")
    # star edges to the least class of each shared prefix shingle
    by_token = candidates.select("node", F.explode("prefix").alias("_t"))
    hubs = by_token.groupBy("_t").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub < _last").drop("_last")
    edges = by_token.join(hubs, "_t").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    cand = components(edges)
    sizes = cand.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    cand = cand.join(sizes, "label").select("node", F.col("label").alias("comp"), F.ceil(F.col("_n") / F.lit(BLOCK)).alias("_blocks"))
    one = candidates.select("node", "tokens").groupBy("node").agg(F.first("tokens").alias("tokens"))
    block = F.pmod(F.xxhash64("node"), F.col("_blocks"))
    members = materialise(one.join(cand, "node").select("node", "comp", "_blocks", block.alias("_block"), "tokens"))

    home = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(nb))).otherwise(F.xxhash64("comp", "_block"))
    cols = lambda x: x.select("_k", "node", "comp", "tokens")
    roots = materialise(cols(members.withColumn("_k", home)).groupBy("_k").applyInArrow(_within(percent), ROOTS))

    # large candidate components: leaders of the blocks' components, then everything outside the largest one
    large = members.where("_blocks > 1")
    if large.limit(1).count():
        of = large.join(roots.drop("comp"), "node")
        met = _leaders_met(of.where("node = root").select("node", "comp", "tokens"), percent)
        first = components(of.select(F.col("node").alias("u"), F.col("root").alias("v")).union(met))
        part = materialise(large.join(first, "node").withColumnRenamed("label", "root"))
        counts = part.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("_n"))
        most = counts.groupBy("comp").agg(F.max(F.struct("_n", "root")).alias("_m"), F.count(F.lit(1)).alias("_parts"))
        most = most.where("_parts > 1").select("comp", F.col("_m.root").alias("_most"))
        split = part.join(most, "comp").withColumn("minor", F.col("root") != F.col("_most"))
        minors = split.where("minor").withColumn("_chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_blocks")))
        chunks = minors.select("comp", "_chunk").distinct()
        # every block meets every chunk of minors; both are bounded by about BLOCK classes
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
        left = split.join(chunks, "comp").select(F.xxhash64("comp", "_block", "_chunk").alias("_k"), "root", F.lit(False).alias("minor"), "tokens")
        right = minors.select("comp", "_chunk", "root", "tokens", every.alias("_block")).select(
            F.xxhash64("comp", "_block", "_chunk").alias("_k"), "root", F.lit(True).alias("minor"), "tokens")
        links = left.union(right).groupBy("_k").applyInArrow(_across(percent), LINKS)
        final = components(part.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links))
        small = roots.join(large.select("node"), "node", "left_anti").select("node", F.col("root").alias("label"))
        labels = small.union(final)
    else:
        labels = roots.select("node", F.col("root").alias("label"))
    return sets, names.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for every row."""
    sets, named = _labelled(docs, n, percent)
    best = named.groupBy("label").agg(F.min("least").alias("component_id"))
    per_class = named.join(best, "label").select("node", "component_id")
    out = sets.select("doc_id", "n_shingles", "node").join(per_class, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of the least doc_id (a null id counts as the greatest), with
    all its columns; documents without words all stay; rows equal in doc_id and text are one document."""
    sets, named = _labelled(docs, n, percent)
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
    whole = sets.where("node is not null").join(named.select("node", "label"), "node")
    kept = whole.groupBy("label").agg(F.min(rank).alias("_r")).select(F.col("_r.d").alias("_d"), F.col("_r.t").alias("_h"))
    kept = kept.union(sets.where("node is null").select("doc_id", "text_hash").distinct())
    h, d, t = X.free_name(docs, "_text_hash"), X.free_name(docs, "_kept_id"), X.free_name(docs, "_kept_hash")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    kept = kept.select(F.col("_d").alias(d), F.col("_h").alias(t))
    out = keyed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left_semi")
    return out.dropDuplicates(["doc_id", h]).drop(h)
