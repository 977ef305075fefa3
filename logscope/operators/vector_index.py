"""An index for dense vectors: inverted lists around trained centres, searched in the nearest lists only.

Beside the exact tiles of ``far_semantic``, for tables where comparing every anomaly with every earlier row is too much.
Work grows with the rows: a list holds about ``list_rows`` rows at every size, and an anomaly looks into ``probes`` lists.

Centres come in two levels, so that both code books stay small and can be broadcast: at most ``MOST_CENTRES`` coarse
centres, and at most as many shared centres of what a row's coarse centre leaves over. A list is a pair of the two. They are fitted
(k-means) on a sample of at most ``SAMPLE_PER_CENTRE`` rows a centre; every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.operators.context import _PAIR_SCHEMA, _block_top_k, _top_k, far_semantic
from logscope.session import materialise

MOST_CENTRES = 2048
SAMPLE_PER_CENTRE = 32
ROUNDS = 8
TILE_ROWS = 16_384


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first (least index on ties); some rows at a time."""
    half = (centres * centres).sum(axis=1) / 2
    out = []
    for lo in range(0, len(x), 1024):
        d = half - x[lo:lo + 1024] @ centres.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(axis=1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def fit_centres(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """k-means centres from farthest-first seeds among a few draws; a centre that loses its rows keeps its place."""
    rng = np.random.default_rng(seed)
    if len(x) <= n:
        return x.copy()
    centres = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=n)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
        if (size == 0).any():  # an empty centre takes a row that is far from its own
            far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1), kind="stable")[:int((size == 0).sum())]
            centres[np.flatnonzero(size == 0)[:len(far)]] = x[far]
    return centres


class CodeBook:
    """Coarse centres, and shared centres of the remainders (one zero vector where the coarse ones are enough)."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int) -> None:
        coarse = min(max(1, lists), MOST_CENTRES)
        self.coarse = fit_centres(sample, coarse, seed) if len(sample) else np.zeros((1, sample.shape[1]))
        fine = min(MOST_CENTRES, -(-lists // len(self.coarse))) if lists > MOST_CENTRES else 1
        rest = sample - self.coarse[_nearest(sample, self.coarse, 1)[:, 0]] if len(sample) else sample
        self.fine = fit_centres(rest, fine, seed + 1) if fine > 1 else np.zeros((1, self.coarse.shape[1]))

    def lists(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """The nearest ``probes`` lists of each row, by the distance to the sum of both centres."""
        c = _nearest(x, self.coarse, min(probes, len(self.coarse)))
        if len(self.fine) == 1:
            return c.astype(np.int64)
        if probes == 1:
            rest = x - self.coarse[c[:, 0]]
            return c.astype(np.int64) * len(self.fine) + _nearest(rest, self.fine, 1)
        n = min(probes, len(self.fine))
        ids, far = [], []
        for j in range(c.shape[1]):
            rest = x - self.coarse[c[:, j]]
            f = _nearest(rest, self.fine, n)
            ids.append(c[:, j:j + 1].astype(np.int64) * len(self.fine) + f)
            far.append(((rest[:, None, :] - self.fine[f]) ** 2).sum(axis=2))
        ids, far = np.concatenate(ids, axis=1), np.concatenate(far, axis=1)
        return np.take_along_axis(ids, np.argsort(far, axis=1, kind="stable")[:, :probes], axis=1)


def _lists_of(book, probes: int):
    """Adds the lists of each row's vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = np.asarray(part.column("_vec").to_pylist(), np.float64).reshape(part.num_rows, -1)
                lists = book.value.lists(_unit(x), probes)
                off = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * lists.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(off, pa.array(lists.ravel()))], [*part.schema.names, "_lists"])
    return run


def fit_index(vectors: DataFrame, list_rows: int, seed: int = 42) -> CodeBook:
    """A code book for ``(_id, _vec)`` with about ``rows / list_rows`` lists, from the rows of least hash."""
    n = vectors.count()
    lists = max(1, math.ceil(n / list_rows))
    size = SAMPLE_PER_CENTRE * min(lists, MOST_CENTRES)
    drawn = vectors.withColumn("_o", F.xxhash64("_id", F.lit(seed)))
    if n > 2 * size:  # keep about twice the sample before sorting
        drawn = drawn.where(F.pmod("_o", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * size / n)))
    rows = drawn.orderBy("_o", "_id").limit(size).select("_vec").collect()
    sample = _unit(np.asarray([r["_vec"] for r in rows], np.float64)) if rows else np.zeros((0, 1))
    return CodeBook(sample, lists, seed)


def far_semantic_index(df: DataFrame, k: int = 5, vec_col: str = "embedding", earlier_only: bool = True, id_col: str = "LineId",
                       pos_col: str = "pos", flag_col: str = "anomaly", list_rows: int = 1024, probes: int = 8, seed: int = 42) -> DataFrame:
    """Top ``k`` rows (of smaller id) by cosine of dense vectors, searched in the ``probes`` nearest lists of each anomaly.

    Edges as from ``far_semantic``. Similarities are exact; a row in a list that is not looked into can be missed. With at most
    ``probes`` lists (``list_rows * probes`` rows) all are looked into, and the result is the exact one. An anomaly that finds fewer
    than ``k`` rows is asked again by the exact tiles, so no anomaly gets fewer edges than there.

    A list that holds many rows (near copies share theirs) is compared in tiles of ``TILE_ROWS`` rows, anomalies
    likewise, so no task grows with it; of equal vectors only the ``k`` of least id are candidates at all."""
    spark = df.sparkSession
    base = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(flag_col).alias("_flag"), F.col(vec_col).cast("array<double>").alias("_vec"))
    same = Window.partitionBy(F.xxhash64("_vec"), F.xxhash64(F.lit(1), "_vec")).orderBy("_id")
    keyed = base.withColumn("_chosen", F.row_number().over(same) <= k)
    keyed = materialise(keyed.where(F.col("_chosen") | (F.col("_flag") == F.lit(True))))
    book = spark.sparkContext.broadcast(fit_index(keyed.where("_chosen").select("_id", "_vec"), list_rows, seed))
    shape = "_id long, _vec array<double>, _lists array<long>"
    cands = materialise(keyed.where("_chosen").select("_id", "_vec").mapInArrow(_lists_of(book, 1), shape).select("_id", "_vec", F.col("_lists")[0].alias("_list")))
    asked = materialise(keyed.where(F.col("_flag") == F.lit(True)).select("_id", "_vec").mapInArrow(_lists_of(book, probes), shape)
                        .select("_id", "_vec", F.explode("_lists").alias("_list")))
    tiles = lambda d, name: d.groupBy("_list").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_ROWS)).cast("int").alias(name))
    shared = materialise(tiles(cands, "_nc").join(tiles(asked, "_na"), "_list"))

    def side(d: DataFrame, own: str, other: str, n_own: str, n_other: str, names: tuple[str, str]) -> DataFrame:
        return (d.join(shared, "_list").withColumn(own, F.pmod(F.xxhash64("_id"), F.col(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
                .select("_list", "_at", "_ct", F.col("_id").alias(names[0]), F.col("_vec").alias(names[1])))
    a = side(asked, "_at", "_ct", "_na", "_nc", ("anomaly_id", "_avec"))
    c = side(cands, "_ct", "_at", "_nc", "_na", ("context_id", "_cvec"))
    keys = ["_list", "_at", "_ct"]
    local = a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(_block_top_k(k, earlier_only), _PAIR_SCHEMA)
    top = materialise(_top_k(local, k).select("anomaly_id", "context_id", "similarity", "rank"))
    full = top.groupBy("anomaly_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("anomaly_id")
    open_ = materialise(keyed.where(F.col("_flag") == F.lit(True)).select(F.col("_id").alias("anomaly_id")).join(full, "anomaly_id", "left_anti"))
    top = top.join(full, "anomaly_id", "left_semi")
    pos = df.select(F.col(id_col).cast("long").alias("_id"), F.col(pos_col).alias("_pos"))
    out = (top.join(pos.select(F.col("_id").alias("anomaly_id"), F.col("_pos").alias("anomaly_pos")), "anomaly_id")
           .join(pos.select(F.col("_id").alias("context_id"), F.col("_pos").alias("context_pos")), "context_id"))
    out = out.select("anomaly_id", "anomaly_pos", "context_id", "context_pos", F.lit("semantic").alias("kind"), F.col("rank").cast("int"), "similarity")
    if open_.limit(1).count():
        again = df.join(open_.withColumnRenamed("anomaly_id", "_open"), df[id_col] == F.col("_open"), "left").withColumn(flag_col, F.col("_open").isNotNull()).drop("_open")
        out = out.unionByName(far_semantic(again, k, vec_col, earlier_only, id_col, pos_col, flag_col))
    return out


def pairs_compared(df: DataFrame, book: CodeBook, probes: int) -> int:
    """Vector pairs that a search of all rows of ``(_id, _vec, _flag)`` compares: for each anomaly the rows of its lists."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(book)
    shape = "_id long, _vec array<double>, _lists array<long>"
    sizes = df.select("_id", "_vec").mapInArrow(_lists_of(shared, 1), shape).groupBy(F.col("_lists")[0].alias("_list")).agg(F.count(F.lit(1)).alias("_n"))
    asked = df.where("_flag").select("_id", "_vec").mapInArrow(_lists_of(shared, probes), shape).select(F.explode("_lists").alias("_list"))
    return asked.join(sizes, "_list").agg(F.sum("_n")).first()[0] or 0
