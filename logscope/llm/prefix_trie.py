"""Conversation prefix trie: ternary search trees per range shard, merged at their boundaries.

A turn is known by the 128-bit MD5 of its role and text; a shard dictionary-encodes the keys it
sees. Conversations are cut into segments of ``segment`` turns, so that no row grows with a
conversation. Segments are range-partitioned by (start, turn keys, conv_id): a node's members
are neighbours, equal conversations can be dealt over many shards, and only nodes on the
paths of a shard's first and last sequence can have members in another shard. Each shard

* encodes its turn keys as dense ids in key order,
* inserts its distinct sequences into a ternary search tree, the median first, then the
  medians of both halves, so that the tree is balanced without rotations,
* walks the nodes from the last to the first (parents stand before children) and adds up
  members, leaves and savings.

Nodes inside a shard are final. Boundary nodes leave partial sums, which are added by node, and
carried to their ancestors along stored paths. Lists of ending conversations are hashed as a
stream of sorted chunks, so a conversation repeated by a third of all ids needs no long row.
Segments that start at a node of one conversation only are chains and need no tree; shared
ones are built from the deepest up, a job for each ``segment`` turns that two conversations share.

Defined cases: null conv_ids form no conversation; null role or text is empty text; turns of
equal number stand in order of role, then of their key, repeated rows are repeated turns; other columns
are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.textnp import text_bytes
from logscope.operators.position import range_partitions, running, with_position
from logscope.session import materialise

SEGMENT = 256
SHARD_TURNS = 1_000_000
CHUNK_IDS = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")
FINAL, PENDING, PARTIAL, ENDS, START = range(5)
SHARD = f"kind int, {NODE}, node binary, parent binary, path array<binary>, size long, x_children long, x_leaves long, x_saved long, first long, ids string, start string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def dialogues(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, size): every turn at its place from 0, with its 128-bit key and the code points of its text."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
                             F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    t = c.select("conv_id", "turn", "role", key.alias("key"), F.char_length("text").cast("long").alias("size"))
    return materialise(with_position(t, ["turn", "role", "key"], by="conv_id").select("conv_id", F.col("pos").cast("long").alias("pos"), "key", "size"))


def with_block_heads(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that begin alike: conversation c takes the first h = crc32(c) % heads turns of the
    block's first conversation (c - c % block; fewer if it has fewer) in place of its own first h.
    -> ``(conv_id, pos, key, size)`` as in ``dialogues``, with one row of null key and pos 0 for a conversation left without turns."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    of = F.col("conv_id") - F.col("conv_id") % block
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"))
    first = convs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_b"), F.least("_n", F.lit(heads)).alias("_bn"))
    convs = convs.withColumn("_b", of).withColumn("_h", h).join(first, "_b", "left").withColumn("_nb", F.least("_h", F.coalesce("_bn", F.lit(0))))
    heads_of = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < heads - 1)).select(F.col("conv_id").alias("_b"), "pos", "key", "size")
    taken = convs.where("_nb > 0").select("_b", "_h", "conv_id").join(heads_of, "_b").where("pos < _h").select("conv_id", "pos", "key", "size")
    own = (turns.withColumn("_h", h).where("pos >= _h").withColumn("_b", of).join(first, "_b", "left")
           .select("conv_id", (F.col("pos") - F.col("_h") + F.least("_h", F.coalesce("_bn", F.lit(0)))).alias("pos"), "key", "size"))
    bare = convs.where("_nb = 0 and _n <= _h").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"),
                                                      F.lit(None).cast("long").alias("size"))
    return own.unionByName(taken).unionByName(bare)


def prefix_trie(turns: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct sequence of first turns (node): smallest member, depth, parent's smallest member (root: null), members,
    children, childless nodes in its subtree, the text length saved in its subtree by keeping each node once, and the hash of the
    ids that end there. ``turns`` as from ``dialogues``."""
    entry = F.when(F.col("key").isNotNull(), F.struct("pos", "key", "size"))
    t = turns.withColumn("_seg", F.floor(F.col("pos") / segment))
    cut = F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size")))
    segs = t.groupBy("conv_id", "_seg").agg(cut.alias("_t")).select(
        "conv_id", "_seg", F.col("_t.key").alias("keys"), F.col("_t.size").alias("sizes"))
    segs = materialise(segs)
    about = segs.agg(F.max("_seg").alias("seg"), F.max(F.size("keys")).alias("most"), F.sum(F.size("keys") + 1).alias("n")).first()
    shards = max(range_partitions(segs), -(-(about["n"] or 0) // shard_turns))
    none = F.lit(None).cast("long")
    if not about["seg"] and (about["most"] or 0) < segment:
        rows = segs.select(F.lit("").alias("start"), "keys", "sizes", "conv_id", F.lit(True).alias("stop"),
                           none.alias("x_children"), none.alias("x_leaves"), none.alias("x_saved"))
        return _level(rows, 0, segment, shards)[0]
    return _long(segs, segment, shards)


def _long(segs: DataFrame, segment: int, shards: int) -> DataFrame:
    """Conversations of several segments: chains of one member at once, shared segments from the deepest up."""
    full = segs.where(F.size("keys") == segment)
    hashes = {"_p1": ("sum", F.xxhash64("_seg", "keys").cast("decimal(20,0)")), "_p2": ("sum", F.xxhash64(F.lit("+"), "keys", "_seg").cast("decimal(20,0)"))}
    chain = running(full.select("conv_id", "_seg", "keys"), "conv_id", ["_seg"], hashes).select(
        "conv_id", (F.col("_seg") + 1).alias("_seg"), F.concat_ws(":", F.col("_seg") + 1, F.col("_p1"), F.col("_p2")).alias("start"))
    chain = materialise(chain)  # (conv_id, _seg >= 1, start): every start of a further segment, be it empty
    total = segs.groupBy("conv_id").agg(F.sum(F.size("keys")).cast("long").alias("total"))
    shared = chain.groupBy("start").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    empty = F.array().cast("array<binary>")
    later = materialise(chain.join(shared, "start").join(segs, ["conv_id", "_seg"], "left").join(total, "conv_id")
                        .withColumn("keys", F.coalesce("keys", empty)).withColumn("sizes", F.coalesce("sizes", F.array().cast("array<long>"))))
    # chains
    tail = later.where(~F.col("_shared")).select("conv_id", "total", (F.col("_seg") * segment).alias("_at"), F.posexplode("keys").alias("_i", "_k"))
    depth = F.col("_at") + F.col("_i") + 1
    ends = F.when(depth == F.col("total"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = tail.select("conv_id", depth.cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
                      F.when(depth == F.col("total"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
                      ends.alias("ends_sha256"))
    # what stands below the last node of a full segment, by the start of the next one
    below = later.where(~F.col("_shared")).select(
        "start", F.when(F.size("keys") > 0, one).otherwise(zero).alias("x_children"), one.alias("x_leaves"), zero.alias("x_saved"))
    tops = later.where("_shared").agg(F.max("_seg")).first()[0] or 0
    for level in range(int(tops), -1, -1):
        rows = (later.where("_shared").where(F.col("_seg") == level).select("conv_id", "start", "keys", "sizes") if level else
                segs.where("_seg = 0").select("conv_id", F.lit("").alias("start"), "keys", "sizes"))
        ahead = later.where(F.col("_seg") == level + 1).select("conv_id", F.col("start").alias("_next"), (F.col("total") == (level + 1) * segment).alias("stop"))
        rows = (rows.join(ahead, "conv_id", "left").join(below.withColumnRenamed("start", "_next"), "_next", "left")
                .select("start", "keys", "sizes", "conv_id", F.coalesce("stop", F.lit(True)).alias("stop"), "x_children", "x_leaves", "x_saved"))
        nodes, starts = _level(rows, level, segment, shards)
        out = out.unionByName(nodes)
        below = below.unionByName(starts)
    return out


def _level(rows: DataFrame, level: int, segment: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """The nodes below the starts of one level, and what stands below each start."""
    spread = rows.repartitionByRange(shards, "start", "keys", "conv_id").sortWithinPartitions("start", "keys", "conv_id")
    out = materialise(spread.mapInArrow(_shard_builder(level * segment), SHARD))
    part = out.where(F.col("kind") == PARTIAL)
    b = part.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("path").alias("path"), F.max("start").alias("start"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("x_children", "x_leaves", "x_saved")])
    kids = b.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_kids"))
    b = b.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)) + F.coalesce("x_children", F.lit(0)))
    b = materialise(b.withColumns({
        "n_leaves": F.col("n_leaves") + F.coalesce("x_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0)),
        "saved_tokens": F.col("saved_tokens") + F.coalesce("x_saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("size")}))
    sums = (b.select(F.explode("path").alias("node"), "n_leaves", "saved_tokens").groupBy("node")
            .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    chunks = out.where(F.col("kind") == ENDS).select("node", "first", "ids")
    ends = chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hash_chunks, "node binary, _ends string")
    parents = b.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv"))
    merged = (b.drop("n_leaves", "saved_tokens").join(sums, "node").join(ends, "node", "left").join(parents, "parent", "left")
              .select("conv_id", "depth", F.col("_parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("_ends", F.lit(NO_ENDS)).alias("ends_sha256"), "start"))
    pending = out.where(F.col("kind") == PENDING).join(parents, "parent").withColumn("parent_conv_id", F.col("_parent_conv"))
    at_start = F.col("depth") == level * segment
    nodes = (out.where(F.col("kind") == FINAL).select(*COLUMNS).unionByName(pending.select(*COLUMNS))
             .unionByName((merged.where(~at_start) if level else merged).select(*COLUMNS)))
    starts = merged.where(at_start).unionByName(out.where(F.col("kind") == START).select(*COLUMNS, "start"))
    return nodes, starts.select("start", F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))


class TernaryTree:
    """A ternary search tree over sequences of ints, held in lists; node 0 stands above all sequences.

    ``up`` leads to the node of the sequence's previous symbol; a node stands after its ``up``.
    """

    def __init__(self) -> None:
        self.split, self.low, self.high, self.down = [-1], [-1], [-1], [-1]
        self.up, self.depth, self.size = [-1], [-1], [0]

    def _new(self, symbol: int, up: int, size: int) -> int:
        self.split.append(symbol)
        self.low.append(-1)
        self.high.append(-1)
        self.down.append(-1)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.size.append(size)
        return len(self.split) - 1

    def insert(self, symbols: list[int], sizes: list[int]) -> int:
        """The node of the whole sequence."""
        split, low, high, down = self.split, self.low, self.high, self.down
        above = 0
        for symbol, size in zip(symbols, sizes, strict=True):
            t = down[above]
            if t < 0:
                t = down[above] = self._new(symbol, above, size)
            while split[t] != symbol:
                side = low if symbol < split[t] else high
                if side[t] < 0:
                    side[t] = self._new(symbol, above, size)
                t = side[t]
            above = t
        return above

    def insert_medians(self, sequences: list[tuple[list[int], list[int]]]) -> list[int]:
        """Insert sorted distinct sequences, the median of each stretch before its halves; their nodes."""
        at = [0] * len(sequences)
        stretches = [(0, len(sequences))]
        while stretches:
            lo, hi = stretches.pop()
            if lo < hi:
                mid = (lo + hi) // 2
                at[mid] = self.insert(*sequences[mid])
                stretches += [(lo, mid), (mid + 1, hi)]
        return at

    def path(self, node: int) -> list[int]:
        """The nodes from the first symbol to this one."""
        out = []
        while node > 0:
            out.append(node)
            node = self.up[node]
        return out[::-1]


def _lists(col: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Flat values of a list column without nulls, and the offsets of its rows."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    off = a.offsets.to_numpy().astype(np.int64)
    return a.values.slice(off[0], off[-1] - off[0]), off - off[0]


def _shard_builder(base: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _shard(pa.Table.from_batches(held), base)
    return build


def _shard(tbl: pa.Table, base: int) -> Iterator[pa.RecordBatch]:
    """One range of sorted segments: final nodes, nodes whose parent is a boundary node, partial boundary nodes, chunks of ending ids."""
    flat, off = _lists(tbl.column("keys"))
    raw, _ = text_bytes(flat)
    _, codes = np.unique(np.ascontiguousarray(raw).reshape(-1, 16).view("S16").ravel(), return_inverse=True)
    sizes = _lists(tbl.column("sizes"))[0].to_numpy(zero_copy_only=False).tolist()
    codes, off = codes.ravel().tolist(), off.tolist()
    starts = tbl.column("start").to_pylist()
    ids = tbl.column("conv_id").to_pylist()
    stop = tbl.column("stop").to_pylist()
    extra = list(zip(*(tbl.column(c).to_pylist() for c in ("x_children", "x_leaves", "x_saved")), strict=True))
    by_rank = list(dict.fromkeys(starts))  # rows are sorted, so is this
    rank = {s: i for i, s in enumerate(by_rank)}
    sequences, rows_of = [], []
    for i in range(len(ids)):
        symbols = [rank[starts[i]], *codes[off[i]:off[i + 1]]]
        if sequences and sequences[-1][0] == symbols:
            rows_of[-1][1] = i + 1
        else:
            sequences.append((symbols, [0, *sizes[off[i]:off[i + 1]]]))
            rows_of.append([i, i + 1])
    tree = TernaryTree()
    at = tree.insert_medians(sequences)
    n = len(tree.split)
    members, least, kids, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    last_of = {}
    for node, rows in zip(at, rows_of, strict=True):
        last_of[node] = rows
        members[node], least[node] = rows[1] - rows[0], ids[rows[0]]
    keys = raw.reshape(-1, 16)
    boundary = {}  # node -> key
    paths = {}
    for s in (0, -1):
        row = rows_of[s][0]
        turn_keys = keys[off[row]:off[row + 1]]
        digest = hashlib.blake2b(starts[row].encode() + b"|", digest_size=16)
        nodes = tree.path(at[s])
        for k, node in enumerate(nodes):
            if k:
                digest.update(turn_keys[k - 1].tobytes())
            boundary[node] = digest.copy().digest()
            paths[node] = [boundary[x] for x in nodes[:k + 1]]
    up = tree.up
    for v in range(n - 1, 0, -1):  # children stand after their parents
        x = extra[last_of[v][0]] if v in last_of else (None, None, None)
        if v not in boundary:
            if x[1] is not None:
                kids[v] += x[0]
                leaves[v] += x[1]
                saved[v] += x[2]
            elif not kids[v]:
                leaves[v] = 1
            saved[v] += (members[v] - 1) * tree.size[v]
        u = up[v]
        if u > 0:
            members[u] += members[v]
            if least[u] is None or least[v] < least[u]:
                least[u] = least[v]
            if v not in boundary:
                kids[u] += 1
                leaves[u] += leaves[v]
                saved[u] += saved[v]
    rows = []
    for v in range(1, n):
        u = up[v]
        ended = [c for c, s in zip(ids[slice(*last_of[v])], stop[slice(*last_of[v])], strict=True) if s] if v in last_of else []
        depth = base + tree.depth[v]
        sums = (members[v], kids[v], leaves[v], saved[v])
        if v in boundary:
            x = extra[last_of[v][0]] if v in last_of else (None, None, None)
            start = starts[0] if paths[v][0] == paths[at[0]][0] else starts[-1]
            rows.append((PARTIAL, least[v], depth, None, *sums, None, boundary[v], boundary.get(u), paths[v], tree.size[v], *x, None, None, start))
            for k in range(0, len(ended), CHUNK_IDS):
                part = ended[k:k + CHUNK_IDS]
                rows.append((ENDS, *[None] * 8, boundary[v], *[None] * 6, part[0], ",".join(map(str, part)), None))
        else:
            sha = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else NO_ENDS
            if tree.depth[v] == 0 and base:
                kind, start = START, by_rank[tree.split[v]]
            else:
                kind, start = (PENDING if u in boundary else FINAL), None
            rows.append((kind, least[v], depth, least[u] if u > 0 else None, *sums, sha, None, boundary.get(u), None, None, None, None, None, None, None, start))
        if len(rows) >= 50_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in SHARD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose sorted chunks come one after the other."""
    node, state, done = None, None, []

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "_ends"])

    for batch in batches:
        for key, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if len(done) >= 10_000:
            yield out(done)
            done = []
    if node is not None:
        done.append((node, state.hexdigest()))
    if done:
        yield out(done)


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT b, 0 AS i, b AS x FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
  UNION ALL
  SELECT b, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE i < 8
), tab AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE i = 8),
ids AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT c, CAST(c AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS x FROM ids
  UNION ALL
  SELECT c, s, i + 1, xor(x >> 8, t[CAST(xor(x, ascii(substr(s, i + 1, 1))) & 255 AS BIGINT) + 1]) FROM crc, tab WHERE i < length(s)
), heads AS (SELECT c, xor(x, 4294967295) % 6 AS h FROM crc WHERE i = length(s)),
turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), made AS (
  SELECT h.c, 0 AS part, t.p, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c - h.c % 100 AND t.p < h.h
  UNION ALL
  SELECT h.c, 1 AS part, t.p, t.role, t.text FROM heads h JOIN turns t ON t.c = h.c AND t.p >= h.h
), placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, md5(strlen(role) || ':' || role || text) AS k, length(text) AS len FROM made
), member AS (
  SELECT c, 0 AS d, '' AS path, 0 AS len FROM ids
  UNION ALL
  SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path, len FROM placed
), total AS (SELECT c, max(d) AS n FROM member GROUP BY c),
node AS (
  SELECT path, any_value(m.d) AS d, min(m.c) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
         sha256(coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE m.d = t.n), '')) AS ends
  FROM member m JOIN total t ON t.c = m.c GROUP BY path
), kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
under AS (
  SELECT left(w.path, CAST(w.r AS BIGINT) * 32) AS path, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((w.n_convs - 1) * w.len) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS r FROM node) w LEFT JOIN kids k ON k.path = w.path GROUP BY 1
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(k.k, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM node v JOIN under s ON s.path = v.path LEFT JOIN kids k ON k.path = v.path
LEFT JOIN node u ON v.d > 0 AND u.path = left(v.path, length(v.path) - 32)
"""
