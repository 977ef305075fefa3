"""Anomaly detection (AD1, AD3, AD5): a hash split, an isolation forest and detector metrics."""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.operators.position import running
from logscope.operators.prepare import seeded_order
from logscope.session import materialise



def split(df: DataFrame, test_frac: float = 0.9, seed: int = 42, id_cols: Sequence[str] = ("LineId",)) -> tuple:
    """Shuffled train/test split by a seeded hash threshold: stable under re-partitioning."""
    u = F.conv(F.substring(seeded_order(id_cols, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.where(u >= test_frac), df.where(u < test_frac)


def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


_TREE_SCHEMA = T.StructType([
    T.StructField("_f", T.StringType()), T.StructField("_tree", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())), T.StructField("word", T.ArrayType(T.LongType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())), T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())), T.StructField("size", T.ArrayType(T.IntegerType())),
])

# Rows of one tile side: a tile's scratch is a few of these times the words or rows of the other side.
TILE = 2048


def _prepared(df: DataFrame, features: Sequence[str], id_col: str, by: str | None, words_col: str | None) -> DataFrame:
    """``_f`` (group, "" without one), ``_id``, ``_x`` (numbers) and ``_w`` (sorted word hashes, repeats kept)."""
    words = F.sort_array(F.transform(F.coalesce(F.col(words_col), F.array().cast("array<string>")), lambda w: F.xxhash64(w))) \
        if words_col else F.array().cast("array<long>")
    return df.select((F.col(by).cast("string") if by else F.lit("")).alias("_f"), F.col(id_col).alias("_id"),
                     F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), words.alias("_w"))


def _counts(words: list, vocabulary: np.ndarray) -> np.ndarray:
    """Dense counts of the given (sorted) word hashes in each row."""
    out = np.zeros((len(words), len(vocabulary)))
    if len(vocabulary):
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate([np.asarray(w, np.int64) for w in words]) if len(row) else np.zeros(0, np.int64)
        at = np.searchsorted(vocabulary, flat)
        at[at == len(vocabulary)] = 0
        held = vocabulary[at] == flat
        np.add.at(out, (row[held], at[held]), 1.0)
    return out


def _vocabulary(words: list) -> np.ndarray:
    parts = [np.asarray(w, np.int64) for w in words if len(w)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _fit_tree(seed: int, height_limit: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_tree"].iloc[0])
        pdf = pdf.sort_values("_o", kind="stable")
        words = pdf["_w"].tolist()
        vocabulary = _vocabulary(words)
        numbers = np.asarray(pdf["_x"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
        x = np.concatenate([numbers, _counts(words, vocabulary)], axis=1)
        n_numbers = numbers.shape[1]
        rng = np.random.default_rng([seed, t])
        nodes: list[list] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0, 0.0, -1, -1, len(rows)])
            part = x[rows]
            lo, hi = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(hi > lo)  # features that still differ here
            if depth >= height_limit or len(rows) <= 1 or not len(open_):
                return at
            f = int(rng.choice(open_))
            cut = rng.uniform(lo[f], hi[f])
            below = part[:, f] < cut
            if not below.any() or below.all():
                below = part[:, f] <= lo[f]
                cut = np.nextafter(lo[f], hi[f])
            nodes[at][0], nodes[at][2] = (f, cut) if f < n_numbers else (-2, cut)
            nodes[at][1] = int(vocabulary[f - n_numbers]) if f >= n_numbers else 0
            nodes[at][3] = grow(rows[below], depth + 1)
            nodes[at][4] = grow(rows[~below], depth + 1)
            return at

        grow(np.arange(len(x)), 0)
        feature, word, cut, left, right, size = (list(c) for c in zip(*nodes))
        return pd.DataFrame({"_f": [pdf["_f"].iloc[0]], "_tree": [t], "feature": [feature], "word": [word], "threshold": [cut],
                             "left": [left], "right": [right], "size": [size]})
    return fit


class _Forest:
    """The trees of one group, packed for scoring: nodes of all trees in flat arrays, child numbers made absolute."""

    def __init__(self, trees: pd.DataFrame):
        sizes = [len(f) for f in trees["feature"]]
        self.root = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        flat = lambda c, t: np.concatenate([np.asarray(v, t) for v in trees[c]])
        base = np.repeat(self.root, sizes)
        self.feature, self.cut = flat("feature", np.int32), flat("threshold", np.float64)
        self.left, self.right = flat("left", np.int64) + base, flat("right", np.int64) + base
        size = flat("size", np.int64)
        self.rest = np.array([_c(n) for n in range(int(size.max()) + 1)])[size]
        self.norm = _c(max(int(size[self.root].max()), 1))
        word = flat("word", np.int64)
        self.words = np.unique(word[self.feature == -2])
        self.word_column = np.searchsorted(self.words, word)

    def scores(self, numbers: np.ndarray, words: list) -> np.ndarray:
        """``2^(-mean path / c(sample))`` of each row; rows are taken some at a time, so their dense counts stay small."""
        step = max(16, min(TILE, (1 << 23) // max(1, len(self.words), len(self.root))))
        return np.concatenate([np.zeros(0)] + [self._scores(numbers[lo:lo + step], words[lo:lo + step]) for lo in range(0, len(numbers), step)])

    def _scores(self, numbers: np.ndarray, words: list) -> np.ndarray:
        if self.norm <= 0:
            return np.full(len(numbers), 0.5)
        x = np.concatenate([numbers, _counts(words, self.words)], axis=1)
        column = np.where(self.feature == -2, numbers.shape[1] + self.word_column, self.feature)
        node = np.broadcast_to(self.root, (len(x), len(self.root))).copy()  # (row, tree)
        path = np.zeros(node.shape)
        while True:
            row, tree = np.nonzero(self.feature[node] != -1)
            if not len(row):
                break
            at = node[row, tree]
            node[row, tree] = np.where(x[row, column[at]] < self.cut[at], self.left[at], self.right[at])
            path[row, tree] += 1
        return np.power(2.0, -(path + self.rest[node]).mean(axis=1) / self.norm)


def _scored(rows: pd.DataFrame, forest: _Forest | None) -> pd.DataFrame:
    """Scores of the rows of one group; NaN where nothing was fitted."""
    if not len(rows):
        return pd.DataFrame({"_f": [], "_id": [], "pred_ano_proba": []})
    score = forest.scores(_numbers(rows["_x"]), rows["_w"].tolist()) if forest else np.full(len(rows), np.nan)
    return pd.DataFrame({"_f": rows["_f"], "_id": rows["_id"], "pred_ano_proba": score})


def _score_stream(forests):
    """Rows of any groups as they come, against the broadcast forests."""
    def run(batches):
        for rows in batches:
            for f, part in rows.groupby("_f", sort=False, dropna=False):
                yield _scored(part, forests.value.get(f))
    return run


def _score_tile(key, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    return _scored(rows, _Forest(trees) if len(trees) else None)


# Forests up to this many nodes in all (about 48 bytes each) are broadcast; more of them meet their rows by a shuffle.
BROADCAST_NODES = 4 << 20


def _attach(test: DataFrame, score: DataFrame, id_col: str, by: str | None, limit: float) -> DataFrame:
    """Scores joined to the test rows; ``pred_ano`` is 0 where there is no score."""
    f = F.col(by).cast("string") if by else F.lit("")
    out = test.join(score.withColumnsRenamed({"_f": "_sf", "_id": "_sid"}), (test[id_col] == F.col("_sid")) & (f == F.col("_sf")), "left")
    out = out.drop("_sid", "_sf").withColumn("pred_ano_proba", F.nanvl("pred_ano_proba", F.lit(None).cast("double")))
    return out.withColumn("pred_ano", F.coalesce((F.col("pred_ano_proba") > limit).cast("int"), F.lit(0)))


def isolation_forest(train: DataFrame, test: DataFrame, features: Sequence[str], trees: int = 100,
                     psi: int = 256, seed: int = 42, id_col: str = "LineId", by: str | None = None,
                     words_col: str | None = None) -> DataFrame:
    """Isolation forest (Liu et al. 2008) fitted on ``train``, scoring ``test``; with ``by`` one forest per
    group (file), so a group's scores depend on its own rows alone. Features are the numbers and, with
    ``words_col``, the counts of all words. Adds ``pred_ano = score > 0.5`` (``contamination='auto'``) and ``pred_ano_proba`` (null
    where a group has no train row); see ``fit_forest`` and ``score_forest``."""
    forest = fit_forest(train, features, trees, psi, seed, id_col, by, words_col)
    return _attach(test, score_forest(test, forest, features, id_col, by, words_col), id_col, by, 0.5)


def fit_forest(train: DataFrame, features: Sequence[str], trees: int = 100, psi: int = 256, seed: int = 42,
               id_col: str = "LineId", by: str | None = None, words_col: str | None = None) -> DataFrame:
    """One row per group and tree (``_TREE_SCHEMA``), written as a table: scoring reads it twice.

    Each tree gets the ``psi`` train rows of its group with the smallest hash of (id, seed, tree)
    (a partial group limit before the shuffle); trees are fitted in parallel, one task group each. A forest has at
    most ``trees * (2 psi - 1)`` nodes. A node is a leaf (feature -1), a number (its place) or a word (-2, ``word``); rows with
    a value below ``threshold`` go left."""
    tr = _prepared(train, features, id_col, by, words_col)
    n = tr.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    # oversample by hash, then keep exactly the psi smallest hashes
    draw = F.xxhash64(F.col("_id"), F.lit(seed), F.col("_tree"))
    tr = tr.join(n, "_f").withColumn("_tree", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col("_id"), F.lit(seed), t), F.lit(1_000_000))
        < F.least(F.lit(1_000_001.0), F.lit(3e6 * psi) / F.col("_n") + 64e6 / F.col("_n") + 1))))
    w = Window.partitionBy("_f", "_tree").orderBy("_o", "_id")
    tr = tr.withColumn("_o", draw).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi)
    height = int(math.ceil(math.log2(max(psi, 2))))
    return materialise(tr.select("_f", "_tree", "_o", "_x", "_w").groupBy("_f", "_tree").applyInPandas(_fit_tree(seed, height), _TREE_SCHEMA))


def score_forest(test: DataFrame, forest: DataFrame, features: Sequence[str], id_col: str = "LineId", by: str | None = None,
                 words_col: str | None = None) -> DataFrame:
    """``_f``, ``_id``, ``pred_ano_proba = 2^(-E[h(x)] / c(sample))`` for each test row.

    The nodes of all forests are counted first. Up to ``BROADCAST_NODES`` the packed forests are broadcast, once for each executor, and
    test rows stream past them without a shuffle. Beyond that (many groups) rows and forest of a group meet in tiles of 16 ``TILE``
    rows, so a large group is spread over tasks and its forest is copied once for each tile. Scores are the same."""
    te = _prepared(test, features, id_col, by, words_col)
    schema = T.StructType([T.StructField("_f", T.StringType()), T.StructField("_id", test.schema[id_col].dataType), T.StructField("pred_ano_proba", T.DoubleType())])
    nodes = forest.agg(F.sum(F.size("feature"))).first()[0] or 0
    if nodes <= BROADCAST_NODES:
        held = forest.orderBy("_f", "_tree").toPandas()
        forests = test.sparkSession.sparkContext.broadcast({f: _Forest(part) for f, part in held.groupby("_f", sort=False)})
        return te.mapInPandas(_score_stream(forests), schema)
    blocks = te.groupBy("_f").agg(F.ceil(F.count(F.lit(1)) / F.lit(16 * TILE)).cast("int").alias("_nb"))
    te = te.join(blocks, "_f").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int")).select("_f", "_b", "_id", "_x", "_w")
    forest = forest.join(blocks, "_f").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb")
    return te.groupBy("_f", "_b").cogroup(forest.groupBy("_f", "_b")).applyInPandas(_score_tile, schema)


def detector_metrics(df: DataFrame, label_col: str = "anomaly", score_col: str = "pred_ano_proba",
                     pred_col: str = "pred_ano") -> DataFrame:
    """Accuracy, precision, recall, F1 of ``pred`` against ``label``, and ROC AUC of the score.

    AUC is the tie-averaged rank sum over per-score counts: one aggregate per
    distinct score and a skew-safe running sum of negatives, no global row sort.
    """
    lab = F.col(label_col).cast("boolean")
    pred = F.col(pred_col).cast("boolean")
    per = df.groupBy(F.col(score_col).alias("_s")).agg(
        F.count_if(lab).alias("_pos"), F.count_if(~lab).alias("_neg"),
        F.count_if(lab & pred).alias("_tp"), F.count_if(~lab & pred).alias("_fp"),
        F.count_if(lab & ~pred).alias("_fn"), F.count_if(~lab & ~pred).alias("_tn"))
    per = running(per, None, ["_s"], {"_negcum": ("sum", "_neg")})
    x = per.agg(F.sum(F.col("_pos") * (F.col("_negcum") - F.col("_neg") + 0.5 * F.col("_neg"))).alias("_num"),
                F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
                *[F.sum(f"_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return x.select(
        F.round((tp + tn) / (tp + tn + fp + fn), 6).alias("accuracy"),
        F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
        F.round(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0), 6).alias("f1"),
        F.round(F.try_divide(F.col("_num"), F.col("_p") * F.col("_n")), 6).alias("auc"))


_KNN_SCHEMA = T.StructType([T.StructField("_f", T.StringType()), T.StructField("_q", T.LongType()), T.StructField("_o", T.LongType()),
                            T.StructField("_d", T.DoubleType())])


def _distances(qx: np.ndarray, qw: list, ox: np.ndarray, ow: list, apart: np.ndarray | float = 0.0, columns: int = 4096) -> np.ndarray:
    """Euclidean distances between rows of numbers and word counts, to 12 digits; ``apart`` is added to their squares."""
    dot, qq, oo = qx @ ox.T, (qx * qx).sum(1), (ox * ox).sum(1)
    vocabulary = np.union1d(_vocabulary(qw), _vocabulary(ow))
    for lo in range(0, len(vocabulary), columns):  # word counts, some thousand words at a time
        a, b = _counts(qw, vocabulary[lo:lo + columns]), _counts(ow, vocabulary[lo:lo + columns])
        dot += a @ b.T
        qq += (a * a).sum(1)
        oo += (b * b).sum(1)
    return np.round(np.sqrt(np.maximum(qq[:, None] + oo[None, :] - 2 * dot + apart, 0.0)), 12)


def _numbers(column: pd.Series) -> np.ndarray:
    return np.asarray(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _tile_knn(k: int, exclude_self: bool):
    def run(key, q: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"_f": [], "_q": [], "_o": [], "_d": []})
        if q.empty or o.empty:
            return none
        d = _distances(_numbers(q["_qx"]), q["_qw"].tolist(), _numbers(o["_ox"]), o["_ow"].tolist(),
                       q["_qu"].to_numpy(np.float64)[:, None] + o["_ou"].to_numpy(np.float64)[None, :])
        qi, oi = q["_qid"].to_numpy(), o["_oid"].to_numpy()
        if exclude_self:
            d = np.where(qi[:, None] == oi[None, :], np.inf, d)
        kk = min(k, d.shape[1])
        kth = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        rows, cols = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
        # k rows at most for each query: the nearest, of equal ones those of the least id
        order = np.lexsort((oi[cols], d[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols = rows[place < k], cols[place < k]
        return pd.DataFrame({"_f": q["_qf"].to_numpy()[rows], "_q": qi[rows].astype("int64"), "_o": oi[cols].astype("int64"), "_d": d[rows, cols]})
    return run


# Points in a cell, and cells of one group at most (a query holds a distance to each pivot for a moment).
CELL = 256
MOST_CELLS = 256
_SLACK = 1e-9  # distances are rounded to 12 digits


def _own_cell(key, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """The nearest pivot of each row (the first on ties), and the distance to it."""
    if rows.empty or pivots.empty:
        return pd.DataFrame(columns=["_f", "_id", "_x", "_w", "_u", "_cell", "_r"], dtype=object)
    pivots = pivots.sort_values("_cell")
    d = _distances(_numbers(rows["_x"]), rows["_w"].tolist(), _numbers(pivots["_px"]), pivots["_pw"].tolist())
    near = d.argmin(axis=1)
    return pd.DataFrame({"_f": rows["_f"], "_id": rows["_id"], "_x": rows["_x"], "_w": rows["_w"], "_u": rows["_u"],
                         "_cell": pivots["_cell"].to_numpy()[near], "_r": d[np.arange(len(d)), near]})


def _cells_to_search(key, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """For each query the cells that can hold one of its nearest points.

    Distances to pivots leave out own words, which add ``u`` of both rows to a square. Some cell has ``k`` points within ``kth`` of its
    pivot, so the square of the ``k``-th nearest point's distance is at most the least ``(d(q, pivot) + kth)^2 + greatest u`` (the query's
    own ``u`` stands on both sides). A cell is left out when its points are farther by the triangle inequality (they lie
    between ``least`` and ``most`` from their pivot) or by the plane between its pivot and the query's own."""
    if rows.empty or pivots.empty:
        return pd.DataFrame(columns=["_f", "_id", "_x", "_w", "_u", "_cells"], dtype=object)
    pivots = pivots.sort_values("_cell")
    px, pw = _numbers(pivots["_px"]), pivots["_pw"].tolist()
    d = _distances(_numbers(rows["_x"]), rows["_w"].tolist(), px, pw)
    between = _distances(px, pw, px, pw)
    own = d.argmin(axis=1)
    limit = ((d + pivots["_kth"].fillna(np.inf).to_numpy()) ** 2 + pivots["_umost"].to_numpy(np.float64)).min(axis=1)
    bound = np.maximum(d - pivots["_most"].to_numpy(), pivots["_least"].to_numpy() - d)
    apart = between[own]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d * d - np.take_along_axis(d, own[:, None], 1) ** 2) / (2 * apart)
    bound = np.maximum(bound, np.where(apart > 0, plane, 0.0))
    cells = pivots["_cell"].to_numpy()
    search = np.maximum(bound - _SLACK, 0.0) ** 2 + pivots["_uleast"].to_numpy(np.float64) <= limit[:, None] * (1 + _SLACK) + _SLACK
    return pd.DataFrame({"_f": rows["_f"], "_id": rows["_id"], "_x": rows["_x"], "_w": rows["_w"], "_u": rows["_u"], "_cells": [cells[s].tolist() for s in search]})


def _without_own_words(queries: DataFrame, points: DataFrame, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with the words that some other row of the group has too (``_w``), and the sum of squared counts of the rest (``_u``).

    A word of one row only is as far from every other row: it adds its squared count to each squared distance. Without such words (ids,
    addresses, times) many lines are equal, and others stand much closer to the pivots. When a query leaves itself
    out, the row of its id on the other side is itself."""
    both = points.select(F.lit(0).alias("_side"), "_f", "_id", "_w").unionByName(queries.select(F.lit(1).alias("_side"), "_f", "_id", "_w"))
    held = materialise(both.select("_side", "_f", "_id", F.explode("_w").alias("_word")).groupBy("_side", "_f", "_id", "_word").agg(F.count(F.lit(1)).alias("_c")))
    row = F.struct(F.lit(0).alias("_side") if exclude_self else F.col("_side"), F.col("_id"))
    shared = held.groupBy("_f", "_word").agg((F.min(row) != F.max(row)).alias("_shared"))
    kept = (held.join(shared, ["_f", "_word"]).groupBy("_side", "_f", "_id").agg(
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("_shared"), F.array_repeat("_word", F.col("_c").cast("int")))))).alias("_w"),
        F.coalesce(F.sum(F.when(~F.col("_shared"), F.col("_c") * F.col("_c"))), F.lit(0)).alias("_u")))
    kept = materialise(kept)

    def back(rows: DataFrame, side: int) -> DataFrame:
        mine = kept.where(F.col("_side") == side).drop("_side")
        return rows.drop("_w").join(mine, ["_f", "_id"], "left").select(
            "_f", "_id", "_x", F.coalesce("_w", F.array().cast("array<long>")).alias("_w"), F.coalesce("_u", F.lit(0)).alias("_u"))
    return back(queries, 1), back(points, 0)


def _dealt(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """Points with their cells, and queries with each cell they must look into."""
    queries, points = _without_own_words(queries, points, exclude_self)
    same = Window.partitionBy("_f", "_h1", "_h2").orderBy("_id")
    points = (points.select("_f", F.col("_id"), F.col("_x"), F.col("_w"), F.col("_u"), F.xxhash64("_x", "_w", "_u").alias("_h1"),
                            F.xxhash64(F.lit(1), "_x", "_w", "_u").alias("_h2"))
              .withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k + int(exclude_self)))
    points = materialise(points)
    sizes = points.groupBy("_f").agg(F.least(F.lit(MOST_CELLS), F.ceil(F.count(F.lit(1)) / F.lit(CELL))).cast("int").alias("_m"))
    drawn = Window.partitionBy("_f").orderBy("_h1", "_h2")
    pivots = (points.where("_nth = 1").withColumn("_cell", F.row_number().over(drawn)).where(F.col("_cell") <= MOST_CELLS)
              .join(sizes, "_f").where(F.col("_cell") <= F.col("_m")).select("_f", "_cell", F.col("_x").alias("_px"), F.col("_w").alias("_pw")))
    pivots = materialise(pivots)

    def met(rows: DataFrame, given: DataFrame, fn, schema: T.StructType) -> DataFrame:
        """Rows of a group in blocks, each beside the group's pivots."""
        blocks = rows.groupBy("_f").agg(F.ceil(F.count(F.lit(1)) / F.lit(4 * TILE)).cast("int").alias("_nb"))
        left = rows.join(blocks, "_f").withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")).cast("int")).select("_f", "_b", "_id", "_x", "_w", "_u")
        right = given.join(blocks, "_f").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb").withColumnRenamed("_f", "_pf")
        return left.groupBy("_f", "_b").cogroup(right.groupBy("_pf", "_b")).applyInPandas(fn, schema)

    row = [points.schema[c] for c in ("_f", "_id", "_x", "_w", "_u")]
    cells = materialise(met(points.select("_f", "_id", "_x", "_w", "_u"), pivots, _own_cell,
                            T.StructType([*row, T.StructField("_cell", T.IntegerType()), T.StructField("_r", T.DoubleType())])))
    w = Window.partitionBy("_f", "_cell").orderBy("_r", "_id")
    ranked = cells.withColumn("_n", F.row_number().over(w))
    kth = ranked.where(F.col("_n") == k + int(exclude_self)).select("_f", "_cell", F.col("_r").alias("_kth"))
    about = cells.groupBy("_f", "_cell").agg(F.min("_r").alias("_least"), F.max("_r").alias("_most"), F.min("_u").alias("_uleast"), F.max("_u").alias("_umost")).join(kth, ["_f", "_cell"], "left")
    given = materialise(pivots.join(about, ["_f", "_cell"]))
    row = [queries.schema[c] for c in ("_f", "_id", "_x", "_w", "_u")]
    asked = met(queries, given, _cells_to_search, T.StructType([*row, T.StructField("_cells", T.ArrayType(T.IntegerType()))]))
    return cells, asked.select("_f", "_id", "_x", "_w", "_u", F.explode("_cells").alias("_cell"))


def compared_pairs(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False) -> int:
    """Pairs of rows that ``knn`` compares (the all-pairs form compares every query with every point of its group)."""
    cells, asked = _dealt(queries, points, k, exclude_self)
    n = cells.groupBy("_f", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    return asked.join(n, ["_f", "_cell"]).agg(F.sum("_n")).first()[0] or 0


def knn(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, tile: int = TILE) -> DataFrame:
    """Exact k nearest points (Euclidean) of the same group for every query: ``(_f, _q, _o, _d, _rank)``.

    Inputs carry ``_f``, ``_id``, ``_x`` (numbers) and ``_w`` (word hashes; their counts are further
    coordinates). Words of one row only are taken out first (``_without_own_words``). Of equal points only the ``k`` (one more when
    a query leaves itself out) of least id can be among the nearest, so repeated lines are cut to these.

    A group's points are dealt to the cells of pivots (points of least hash, about one for ``CELL`` points, ``MOST_CELLS`` at most), and a
    query is sent to those cells only that can hold one of its nearest by the distances to the pivots; nothing is lost. A
    cell of many points or queries is cut into tiles of about ``tile``, each a cogroup that emits ``k`` rows a query at most; a final
    ``row_number() <= k`` keeps the nearest of all."""
    cells, asked = _dealt(queries, points, k, exclude_self)
    cells, asked = cells.drop("_r"), materialise(asked)
    key = ["_f", "_cell"]
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias(name))
    nb = materialise(blocks(asked, "_nq").join(blocks(cells, "_no"), key))

    def side(df: DataFrame, own: str, other: str, n_own: str, n_other: str, p: str) -> DataFrame:
        # new names on each side: both can come from one table
        return (df.join(nb, key).withColumn(own, F.pmod(F.xxhash64("_id"), F.col(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
                .select(F.col("_f").alias(f"_{p}f"), F.col("_cell").alias(f"_{p}c"), own, other, F.col("_id").alias(f"_{p}id"),
                        F.col("_x").alias(f"_{p}x"), F.col("_w").alias(f"_{p}w"), F.col("_u").alias(f"_{p}u")))
    q = side(asked, "_qb", "_ob", "_nq", "_no", "q")
    o = side(cells, "_ob", "_qb", "_no", "_nq", "o")
    local = q.groupBy("_qf", "_qc", "_qb", "_ob").cogroup(o.groupBy("_of", "_oc", "_qb", "_ob")).applyInPandas(_tile_knn(k, exclude_self), _KNN_SCHEMA)
    w = Window.partitionBy("_f", "_q").orderBy("_d", "_o")
    return local.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)


def lof(train: DataFrame, test: DataFrame, features: Sequence[str], k: int = 20, id_col: str = "LineId",
        threshold: float = 1.5, by: str | None = None, words_col: str | None = None) -> DataFrame:
    """Local outlier factor (Breunig et al. 2000) of ``test`` rows against ``train``
    (novelty form): k-distance and local reachability density of the train points,
    then for each test row the mean neighbour density over its own density. With ``by`` each group (file) is its
    own data set; with ``words_col`` the counts of all words are features beside the numbers.
    Neighbour search is exact, by pivots (``knn``); the rest are joins and aggregates.
    Adds ``pred_ano_proba`` (the LOF; null where the group has no train row) and ``pred_ano`` (LOF > ``threshold``)."""
    tr = materialise(_prepared(train, features, id_col, by, words_col))
    te = materialise(_prepared(test, features, id_col, by, words_col))  # read by several steps of the search
    nn_tr = materialise(knn(tr, tr, k, exclude_self=True))
    kdist = nn_tr.groupBy("_f", "_q").agg(F.max("_d").alias("_kd")).withColumnRenamed("_q", "_o")
    reach_tr = nn_tr.join(kdist, ["_f", "_o"]).withColumn("_r", F.greatest("_d", "_kd"))
    lrd_tr = reach_tr.groupBy("_f", "_q").agg((1.0 / (F.avg("_r") + F.lit(1e-10))).alias("_lrd")).withColumnRenamed("_q", "_o")
    x = knn(te, tr, k).join(kdist, ["_f", "_o"]).join(lrd_tr, ["_f", "_o"]).withColumn("_r", F.greatest("_d", "_kd"))
    score = x.groupBy("_f", F.col("_q").alias("_id")).agg((F.avg("_lrd") * (F.avg("_r") + F.lit(1e-10))).alias("pred_ano_proba"))
    return _attach(test, score, id_col, by, threshold)


def one_class_svm(train: DataFrame, test: DataFrame, features: Sequence[str], nu: float = 0.5,
                  gamma: float | None = None, dims: int = 256, iters: int = 100, lr: float = 0.1,
                  seed: int = 42) -> DataFrame:
    """One-class SVM, approximate by design: the RBF kernel is replaced by ``dims``
    random Fourier features (Rahimi & Recht 2007) and the primal objective
    ``1/2 |w|^2 + 1/(nu n) sum max(0, rho - w.phi(x)) - rho`` is minimised by full-batch
    subgradient steps. Each step is one pass over the distinct rows of the train split (with
    their numbers) whose per-partition partial sums (``dims + 1`` numbers each) are added on the driver, as a tree
    aggregate would. ``gamma`` defaults to ``1 / (n_features * var(X))`` (sklearn's
    ``scale``). Adds ``pred_ano_proba`` (``rho - w.phi(x)``, higher is more anomalous)
    and ``pred_ano`` (decision below zero)."""
    features = list(features)
    num = [F.col(c).cast("double") for c in features]
    names = [f"_x{i}" for i in range(len(features))]
    # equal rows take every step together: read by every step
    tr = materialise(train.select(*[c.alias(n) for c, n in zip(num, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    if gamma is None:
        each = tr.select(F.explode(F.array(*names)).alias("_v"), "_n")
        mean = each.agg(F.try_divide(F.sum(F.col("_v") * F.col("_n")), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))).alias("m")).first()["m"]
        stats = None if mean is None else each.agg(
            (F.sum((F.col("_v") - F.lit(mean)) ** 2 * F.col("_n")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("_n")))).alias("v")).first()["v"]
        stats = stats or 1.0
        gamma = 1.0 / (len(features) * stats) if stats > 0 else 1.0
    rng = np.random.default_rng(seed)
    W = rng.normal(scale=math.sqrt(2 * gamma), size=(len(features), dims))
    b = rng.uniform(0, 2 * math.pi, size=dims)
    n = tr.agg(F.sum("_n")).first()[0] or 0
    w = np.zeros(dims)
    rho = 0.0
    schema = T.StructType([T.StructField("g", T.ArrayType(T.DoubleType())), T.StructField("c", T.LongType())])
    for _ in range(iters):
        wb, rb = w.copy(), rho

        def part(batches, wb=wb, rb=rb):
            g = np.zeros(dims)
            c = 0
            for pdf in batches:
                phi = math.sqrt(2.0 / dims) * np.cos(pdf[names].to_numpy(np.float64) @ W + b)
                viol = phi @ wb < rb
                times = pdf["_n"].to_numpy()[viol]
                g += times @ phi[viol]
                c += int(times.sum())
            yield pd.DataFrame({"g": [g.tolist()], "c": [c]})
        parts = tr.mapInPandas(part, schema).collect()  # one row per partition: bounded
        g = np.sum([np.asarray(r["g"]) for r in parts], axis=0) if parts else np.zeros(dims)
        cnt = sum(r["c"] for r in parts)
        w = w - lr * (w - g / (nu * n))
        rho = rho - lr * (-1.0 + cnt / (nu * n))

    @F.pandas_udf("double")
    def decision(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(np.float64) for c in xs])
        phi = math.sqrt(2.0 / dims) * np.cos(x @ W + b)
        return pd.Series(rho - phi @ w)

    out = test.withColumn("pred_ano_proba", decision(*num))
    return out.withColumn("pred_ano", (F.col("pred_ano_proba") > 0).cast("int"))
