"""Asking the whole corpus about keys without a row per key.

Documents are dealt into groups by a hash of their id (a few MB of text each).
A group turns its texts into keys, packs the keys of one bucket (a hash range)
into one binary value, and sends one row per (group, bucket). The bucket sees
every group's keys together, answers each packed value with one packed answer,
and the answers return to the groups. So a shuffle moves packed arrays of keys
already reduced within the group - a key that fills a third of the corpus is at
most one entry per group - and Spark keeps doing the partitioning, the shuffle,
the retries and the spilling.

The exchange of documents by group appears several times in one plan and is
the same each time, so Spark runs it once and reuses it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.textnp import U64, runs, text_bytes

LEAST = 64  # groups and buckets, so that small inputs still use many tasks
LAST_ID = np.iinfo(np.int64).max
PARCELS = 64 << 20  # bytes of rows that are put into parcels together


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def group_bytes(size: int, least: int = 2 << 20) -> int:
    """Text in a group: 2 MB, more for a large corpus (so that packed values stay long), 64 MB at most."""
    return min(64 << 20, max(least, size // 2000))


def grouped(docs: DataFrame, size: int, least: int = 2 << 20) -> DataFrame:
    """(doc_id, text, _g): every row in one of about size / group_bytes(size) groups. A null id is spread by its text."""
    n = max(LEAST, size // group_bytes(size, least))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return d.withColumn("_g", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)))


def parcels(d: DataFrame) -> DataFrame:
    """The rows of ``grouped`` as (_g, _x): many rows of a group in one compressed value, so that their exchange writes less."""
    return d.mapInArrow(_wrap, "_g long, _x binary")


def _wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PARCELS:
            yield from _wrapped(held)
            held, size = [], 0
    if held:
        yield from _wrapped(held)


def _wrapped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tbl = pa.Table.from_batches(held)
    g = tbl.column("_g").to_numpy()
    order = np.argsort(g, kind="stable")
    doc_id = tbl.column("doc_id").take(order)
    data, off = text_bytes(tbl.column("text").cast(pa.large_binary()).take(order))
    valid, doc_id = doc_id.is_valid().to_numpy(), doc_id.fill_null(0).to_numpy()
    length = np.diff(off).astype(np.uint32)
    first, end = runs(g[order])
    packed = (zstandard.compress(pack(doc_id[s:e], np.packbits(valid[s:e]), length[s:e], data[off[s]:off[e]]))
              for s, e in zip(first, end, strict=True))
    yield pa.record_batch({"_g": pa.array(g[order][first], pa.int64()), "_x": pa.array(packed, pa.binary())})


def opened(tbl: pa.Table) -> pa.Table:
    """A group's rows (doc_id, text as bytes; a null text is empty) from its parcels, in the order of ``in_order``."""
    parts = [unpack(zstandard.decompress(x), np.int64, np.uint8, np.uint32, np.uint8) for x in tbl.column("_x").to_pylist()]
    if not parts:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.large_binary())})
    doc_id, length, data = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
    valid = np.concatenate([np.unpackbits(p[1], count=len(p[0])) for p in parts]).astype(bool)
    off = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(off), pa.py_buffer(data)])
    return in_order(pa.table({"doc_id": pa.array(doc_id, mask=~valid), "text": text}))


def buckets(size: int) -> int:
    """Buckets for keys: one for 8 MB of text, for more text in a large corpus, for 256 MB at most."""
    return int(max(LEAST, size // min(256 << 20, max(8 << 20, size // 1000))))


def in_order(tbl: pa.Table) -> pa.Table:
    """A group's rows in an order that every evaluation repeats (rows equal in both columns are alike)."""
    return tbl.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids(tbl: pa.Table) -> np.ndarray:
    """doc_ids; a null id counts as greater than any other."""
    return tbl.column("doc_id").fill_null(LAST_ID).to_numpy().astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value. Bytes of equal weight stand together, so the shuffle's compression
    finds the high bytes of small numbers and of sorted keys."""
    head = np.array([len(arrays)] + [a.nbytes for a in arrays], np.uint32)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a for a in arrays)
    return head.tobytes() + b"".join(p.tobytes() for p in planes)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    sizes = np.frombuffer(blob, np.uint32, n, 4)
    out, at = [], 4 + 4 * n
    for t, s in zip(types, sizes, strict=True):
        wide = np.dtype(t).itemsize
        planes = np.frombuffer(blob, np.uint8, int(s), at).reshape(wide, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += int(s)
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Each number as the difference to the one before it (modulo the type's range)."""
    return np.diff(a, prepend=a.dtype.type(0))


def summed(a: np.ndarray) -> np.ndarray:
    """The numbers whose steps these are."""
    return np.cumsum(a, dtype=a.dtype)


def by_bucket(h: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """Places of the hashes of each bucket that has any."""
    b = (h % U64(n_buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], np.arange(n_buckets + 1))
    return [(i, order[first[i]:first[i + 1]]) for i in range(n_buckets) if first[i + 1] > first[i]]


def rows_out(rows: list[tuple], names: tuple[str, ...], types: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})


def blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Rows (group, bucket, packed)."""
    return rows_out(rows, ("_g", "_b", "_x"), (pa.int64(), pa.int32(), pa.binary()))


BLOBS = "_g long, _b int, _x binary"


def each(tbl: pa.Table) -> list[tuple[int, int, bytes]]:
    """Rows of a table of blobs, in the order of group and bucket."""
    return sorted(zip(tbl.column("_g").to_pylist(), tbl.column("_b").to_pylist(), tbl.column("_x").to_pylist(), strict=True))


def small_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as one byte each, and those of 255 and more by themselves."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8), counts[large].astype(np.uint32)


def full_counts(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


# --- which keys occur at least twice -----------------------------------------------------------


def ask_shared(g: int, h: np.ndarray, n_buckets: int) -> tuple[pa.Table, np.ndarray]:
    """A group's distinct keys as 32 bits each (in order, so as steps), and whether the group itself holds the key twice."""
    keys, counts = np.unique(h, return_counts=True)
    out = []
    for b, at in by_bucket(keys, n_buckets):
        out.append((g, b, zstandard.compress(pack(steps((keys[at] >> U64(32)).astype(np.uint32)), np.packbits(counts[at] > 1)), 1)))
    return blobs(out), keys


def answer_shared(tbl: pa.Table) -> pa.Table:
    """A bucket: for each group's keys a bit, true where some other entry has the same 32 bits."""
    rows = each(tbl)
    parts = [unpack(zstandard.decompress(x), np.uint32, np.uint8) for _, _, x in rows]
    all_keys = np.concatenate([summed(k) for k, _ in parts])
    twice = np.concatenate([np.unpackbits(t, count=len(k)) for k, t in parts])
    order = np.argsort(all_keys, kind="stable")
    s = all_keys[order]
    near = np.zeros(len(s), bool)
    near[1:] |= s[1:] == s[:-1]
    near[:-1] |= s[1:] == s[:-1]
    shared = twice.astype(bool)
    shared[order] |= near
    out, at = [], 0
    for (g, b, _), (k, _) in zip(rows, parts, strict=True):
        out.append((g, b, pack(np.packbits(shared[at:at + len(k)]))))
        at += len(k)
    return blobs(out)


def read_shared(answers: pa.Table, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bits of a group's distinct keys, from its answers."""
    got = {b: x for _, b, x in each(answers)}
    shared = np.zeros(len(keys), bool)
    for b, at in by_bucket(keys, n_buckets):
        shared[at] = np.unpackbits(unpack(got[b], np.uint8)[0], count=len(at)).astype(bool)
    return shared
