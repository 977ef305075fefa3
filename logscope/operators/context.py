"""Context selection (CTX2-CTX7, CTX9) as joins over an immutable edge table.

An edge says "row ``context_id`` is context for anomaly ``anomaly_id``":
``(anomaly_id, anomaly_pos, context_id, context_pos, kind, rank, similarity)``.
Inputs carry ``pos`` (see ``position.with_position``), an id column and an
anomaly flag.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.operators.position import with_position
from logscope.session import materialise

EDGE_COLUMNS = ["anomaly_id", "anomaly_pos", "context_id", "context_pos", "kind", "rank", "similarity"]

# Processing order of edge kinds inside one anomaly.
KIND_ORDER = {"self": 0, "near": 1, "semantic": 2, "lexical": 3, "window": 4}

# Token rule of the lexical similarity: lower-cased runs of two or more word characters.
TOKEN_PATTERN = r"(?U)\b\w\w+\b"

SIM_DIGITS = 12  # similarities are rounded before ranking so that equal texts tie exactly


def _anomalies(df: DataFrame, id_col: str, pos_col: str, flag_col: str) -> DataFrame:
    return df.where(F.col(flag_col) == F.lit(True)).select(
        F.col(id_col).alias("anomaly_id"), F.col(pos_col).alias("anomaly_pos"))


def near_context(df: DataFrame, k: int = 6, id_col: str = "LineId", pos_col: str = "pos",
                 flag_col: str = "anomaly") -> DataFrame:
    """``k // 2`` rows before and after each anomaly by position, clipped to the table.

    Anomalies fan out to their neighbour positions and meet the rows in one
    equi-join on ``pos``; no global window, no theta join.
    """
    h = k // 2
    a = _anomalies(df, id_col, pos_col, flag_col)
    off = F.explode(F.sequence(F.lit(-h), F.lit(h))).alias("rank") if h > 0 else F.lit(None).cast("int").alias("rank")
    a = a.select("*", off).where(F.col("rank") != 0).withColumn("context_pos", F.col("anomaly_pos") + F.col("rank"))
    rows = df.select(F.col(id_col).alias("context_id"), F.col(pos_col).alias("context_pos"))
    e = a.join(rows, "context_pos", "inner")
    return e.select("anomaly_id", "anomaly_pos", "context_id", "context_pos", F.lit("near").alias("kind"),
                    F.col("rank").cast("int").alias("rank"), F.lit(None).cast("double").alias("similarity"))


def tokens(text):
    """Lower-cased word tokens of a text column, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def _text_key(text):
    # two independent 64-bit hashes: a 128-bit key for distinct texts
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit("\u0001"), text).alias("_h2")]


def _top_k(pairs: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per anomaly: similarity desc, then earliest candidate.
    ``row_number() <= k`` plans a partial group limit before the shuffle."""
    w = Window.partitionBy("anomaly_id").orderBy(F.col("similarity").desc(), F.col("context_id").asc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _pair_dots(a_terms: DataFrame, c_terms: DataFrame) -> DataFrame:
    """Integer dot products of term-count vectors through a join on shared terms:
    ``a_terms(_a1, _a2, term, _atf)`` x ``c_terms(_h1, _h2, term, tf)`` -> ``(_a1, _a2, _h1, _h2, _dot)``."""
    return (a_terms.join(c_terms, "term")
            .groupBy("_a1", "_a2", "_h1", "_h2").agg(F.sum(F.col("_atf") * F.col("tf")).alias("_dot")))


def _not_beaten(df: DataFrame, keys: list[str], value: str, k: int, earlier_only: bool, parts: str | None = None) -> DataFrame:
    """Of each group the rows that can be among the top ``k`` (value desc, then least ``context_id``) of rows before some id: those
    with fewer than ``k`` rows of smaller id and at least their value (a k-skyband). Without ``earlier_only``, the top ``k``.

    ``parts`` names a column by which large groups are thinned out first, part by part; what
    is beaten in a part is beaten in the whole."""
    if not earlier_only:
        w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col("context_id").asc())
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")

    def run(tbl: pa.Table) -> pa.Table:
        tbl = tbl.sort_by([("context_id", "ascending")])
        best: list[float] = []
        keep = []
        for i, v in enumerate(tbl.column(value).to_pylist()):
            if len(best) < k:
                heapq.heappush(best, v)
            elif v > best[0]:
                heapq.heapreplace(best, v)
            else:
                continue
            keep.append(i)
        return tbl.take(pa.array(keep, pa.int64()))

    if parts:
        df = df.groupBy(*keys, parts).applyInArrow(run, df.schema)
    return df.groupBy(*keys).applyInArrow(run, df.schema)


def far_lexical(df: DataFrame, k: int = 5, earlier_only: bool = True, text_col: str = "message",
                id_col: str = "LineId", pos_col: str = "pos", flag_col: str = "anomaly",
                max_df: float | None = None, hot_df: int = 64, block: int = 4096) -> DataFrame:
    """Top ``k`` earlier rows by cosine of raw term counts (lower-cased ``\\w\\w+`` tokens).

    Exact, in a constant number of jobs, with lossless reductions:

    * similarity depends only on the two texts, so it is computed on distinct texts, of
      each of which only the ``k`` earliest rows can be chosen;
    * zero-similarity fill needs only the first ``k`` rows of the table;
    * terms in at most ``hot_df`` texts are rare: texts that share one are paired by it (at most ``hot_df`` pairs a posting);
    * other texts can share hot terms only. Their similarity depends on the text's hot terms with counts (its signature) and its norm:
      texts of one signature and norm are a class, of which again only the ``k`` earliest rows count;
    * classes stand in blocks of ``block`` in the order of their first rows. Each block has inverted lists and, for each hot
      term, the greatest weight in it. Every signature is compared with the first block. A later block is read
      only if its bound - the sum of its greatest weights for the signature's terms - exceeds the signature's ``k``-th best of
      the first block: rows of equal similarity there are earlier, so they win ties (bounds are compared with a relative slack of 1e-13,
      far below the difference of two unequal similarities of texts of less than some thousand words);
    * what an anomaly row may choose from is the same for all rows of its text but for the limit on ids. A row that ``k`` earlier
      rows equal or beat is never chosen, whatever the limit; the others (a few times ``k``) are kept, joined with the anomaly rows, and cut to ``k``.

    ``max_df`` (off by default) drops terms in more than that fraction of texts:
    an approximation for extreme vocabularies.
    """
    rows = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("context_id"), F.col(pos_col).alias("context_pos"),
        F.col(flag_col).alias("_flag"), F.col(text_col).alias("_text"), *_text_key(F.col(text_col)))

    texts = rows.select("_h1", "_h2", "_text").dropDuplicates(["_h1", "_h2"])
    terms = (texts.select("_h1", "_h2", F.explode(tokens(F.col("_text"))).alias("term"))
             .groupBy("_h1", "_h2", "term").agg(F.count(F.lit(1)).alias("tf")))
    dfreq = terms.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    if max_df is not None:
        n_texts = texts.count()
        dfreq = dfreq.where(F.col("_df") <= max_df * n_texts)
    terms = materialise(terms.join(dfreq, "term").withColumn("_hot", F.col("_df") > hot_df).drop("_df"))

    # of each text only its k earliest rows can be chosen
    wk = Window.partitionBy("_h1", "_h2").orderBy("context_id")
    cands = materialise(rows.withColumn("_r", F.row_number().over(wk)).where(F.col("_r") <= k)
                        .select("_h1", "_h2", "context_id", "context_pos"))
    anomaly_rows = rows.where(F.col("_flag") == F.lit(True)).select(
        F.col("context_id").alias("anomaly_id"), F.col("context_pos").alias("anomaly_pos"),
        F.col("_h1").alias("_a1"), F.col("_h2").alias("_a2"))
    a_keys = anomaly_rows.select("_a1", "_a2").distinct()

    # per text with terms: norm, hot signature (a 128-bit key of its sorted hot terms and counts)
    sig_txt = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("term", "tf"))),
                                       lambda x: F.concat(x["term"], F.lit("\u0001"), x["tf"].cast("string"))),
                           "\u0002")
    sigs = (terms.where("_hot").groupBy("_h1", "_h2").agg(sig_txt.alias("_sigtxt"))
            .select("_h1", "_h2", F.xxhash64("_sigtxt").alias("_s1"), F.xxhash64(F.lit("#"), "_sigtxt").alias("_s2")))
    norms = terms.groupBy("_h1", "_h2").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("_norm"))
    info = materialise(norms.join(sigs, ["_h1", "_h2"], "left"))
    a_info = info.join(a_keys.select(F.col("_a1").alias("_h1"), F.col("_a2").alias("_h2")), ["_h1", "_h2"],
                       "left_semi").select(F.col("_h1").alias("_a1"), F.col("_h2").alias("_a2"),
                                           F.col("_norm").alias("_anorm"), F.col("_s1").alias("_sa1"),
                                           F.col("_s2").alias("_sa2"))
    similarity = lambda dot: F.round(F.try_divide(dot, F.col("_anorm") * F.col("_norm")), SIM_DIGITS).alias("similarity")
    chosen = ["_a1", "_a2", "context_id", "context_pos", "similarity"]

    # terms of signatures (of one text each), and of those of anomalies
    sig_terms = materialise(terms.where("_hot").join(sigs, ["_h1", "_h2"])
                            .dropDuplicates(["_s1", "_s2", "term"]).select("_s1", "_s2", "term", "tf"))
    a_sigs = a_info.select(F.col("_sa1").alias("_s1"), F.col("_sa2").alias("_s2")).where("_s1 IS NOT NULL").distinct()
    a_sig_terms = materialise(sig_terms.join(a_sigs, ["_s1", "_s2"], "left_semi").select(
        F.col("_s1").alias("_sa1"), F.col("_s2").alias("_sa2"), "term", F.col("tf").alias("_atf")))
    dot = F.sum(F.col("_atf") * F.col("tf"))

    # texts that share a rare term with the anomaly text: their whole dot products
    rare = terms.where(~F.col("_hot")).select("_h1", "_h2", "term", "tf")
    a_rare = (rare.join(a_keys.select(F.col("_a1").alias("_h1"), F.col("_a2").alias("_h2")), ["_h1", "_h2"], "left_semi")
              .select(F.col("_h1").alias("_a1"), F.col("_h2").alias("_a2"), "term", F.col("tf").alias("_atf")))
    near = materialise(_pair_dots(a_rare, rare).join(a_info, ["_a1", "_a2"]).join(info, ["_h1", "_h2"]))
    wanted = near.where("_s1 IS NOT NULL AND _sa1 IS NOT NULL").select("_sa1", "_sa2", "_s1", "_s2").distinct()
    hot_dots = (wanted.join(a_sig_terms, ["_sa1", "_sa2"]).join(sig_terms, ["_s1", "_s2", "term"])
                .groupBy("_sa1", "_sa2", "_s1", "_s2").agg(dot.alias("_hdot")))
    by_rare = (near.join(hot_dots, ["_sa1", "_sa2", "_s1", "_s2"], "left").join(cands, ["_h1", "_h2"])
               .select("_a1", "_a2", "context_id", "context_pos", similarity(F.col("_dot") + F.coalesce("_hdot", F.lit(0)))))

    # classes of one signature and norm, in blocks by their first rows
    wc = Window.partitionBy("_s1", "_s2", "_norm").orderBy("context_id")
    members = materialise(cands.join(info.where("_s1 IS NOT NULL"), ["_h1", "_h2"])
                          .withColumn("_r", F.row_number().over(wc)).where(F.col("_r") <= k)
                          .select("_s1", "_s2", "_norm", "context_id", "context_pos", "_r"))
    order = with_position(members.where("_r = 1").select("_s1", "_s2", "_norm", F.col("context_id").alias("_from")), ["_from", "_s1", "_s2", "_norm"], out="_rank")
    order = order.select("_s1", "_s2", "_norm", F.floor(F.col("_rank") / F.lit(block)).alias("_blk"))
    members = materialise(members.drop("_r").join(order, ["_s1", "_s2", "_norm"]))
    lists = members.groupBy("_blk", "_s1", "_s2").agg(F.min("_norm").alias("_least")).join(sig_terms, ["_s1", "_s2"])
    value = F.col("_hdot") / F.col("_norm")

    def compared(pairs: DataFrame) -> DataFrame:
        return (pairs.join(members, ["_blk", "_s1", "_s2"])
                .select("_sa1", "_sa2", "_blk", "context_id", "context_pos", "_norm", "_hdot", value.alias("_v")))

    first = lists.where("_blk = 0").select("_blk", "_s1", "_s2", "term", "tf")
    hits = materialise(compared(a_sig_terms.join(first, "term").groupBy("_sa1", "_sa2", "_blk", "_s1", "_s2").agg(dot.alias("_hdot"))))
    wv = Window.partitionBy("_sa1", "_sa2").orderBy(F.col("_v").desc())
    reached = hits.withColumn("_r", F.row_number().over(wv)).where(F.col("_r") == k).select("_sa1", "_sa2", F.col("_v").alias("_theta"))
    later = materialise(lists.where("_blk > 0").withColumn("_weight", F.col("tf") / F.col("_least")))
    greatest = later.groupBy("_blk", "term").agg(F.max("_weight").alias("_weight"))
    bounds = a_sig_terms.join(greatest, "term").groupBy("_sa1", "_sa2", "_blk").agg(F.sum(F.col("_atf") * F.col("_weight")).alias("_bound"))
    open_ = (bounds.join(reached, ["_sa1", "_sa2"], "left").where(F.col("_theta").isNull() | (F.col("_bound") > F.col("_theta") * (1 + 1e-13)))
             .select("_sa1", "_sa2", "_blk"))
    more = (open_.join(a_sig_terms, ["_sa1", "_sa2"]).join(later, ["_blk", "term"])
            .groupBy("_sa1", "_sa2", "_blk", "_s1", "_s2").agg(dot.alias("_hdot")))
    found = materialise(_not_beaten(hits.unionByName(compared(more)), ["_sa1", "_sa2"], "_v", k, earlier_only, "_blk"))
    by_class = a_info.join(found, ["_sa1", "_sa2"]).select("_a1", "_a2", "context_id", "context_pos", similarity(F.col("_hdot")))

    # zero-similarity fill: only the first k rows of the table can ever be needed
    fill = F.broadcast(rows.orderBy("context_id").limit(k).select("context_id", "context_pos").withColumn("_one", F.lit(1)))
    pads = (a_keys.withColumn("_one", F.lit(1)).join(fill, "_one")
            .select("_a1", "_a2", "context_id", "context_pos", F.lit(0.0).alias("similarity")))

    options = (by_class.unionByName(by_rare).unionByName(pads).groupBy("_a1", "_a2", "context_id", "context_pos")
               .agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity")).select(*chosen))
    options = materialise(_not_beaten(options, ["_a1", "_a2"], "similarity", k, earlier_only))
    pairs = anomaly_rows.join(options, ["_a1", "_a2"])
    if earlier_only:
        pairs = pairs.where(F.col("context_id") < F.col("anomaly_id"))
    top = _top_k(pairs.select("anomaly_id", "anomaly_pos", "context_id", "context_pos", "similarity"), k)
    return top.select("anomaly_id", "anomaly_pos", "context_id", "context_pos", F.lit("lexical").alias("kind"),
                      F.col("rank").cast("int"), "similarity")


_PAIR_SCHEMA = T.StructType([
    T.StructField("anomaly_id", T.LongType()), T.StructField("context_id", T.LongType()),
    T.StructField("similarity", T.DoubleType()),
])


def _block_top_k(k: int, earlier_only: bool, step: int = 512):
    def run(key, anomalies: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"anomaly_id": [], "context_id": [], "similarity": []})
        if anomalies.empty or cands.empty:
            return none
        unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x),
                                   where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
        cv = unit(np.asarray(cands["_cvec"].tolist(), dtype=np.float64))
        aid, cid = anomalies["anomaly_id"].to_numpy(), cands["context_id"].to_numpy()
        vecs = anomalies["_avec"].tolist()
        out_a, out_c, out_s = [], [], []
        for lo in range(0, len(aid), step):  # a strip of the tile at a time
            ids = aid[lo:lo + step]
            sim = np.round(unit(np.asarray(vecs[lo:lo + step], dtype=np.float64)) @ cv.T, SIM_DIGITS)
            if earlier_only:
                sim = np.where(cid[None, :] < ids[:, None], sim, -np.inf)
            kk = min(k, sim.shape[1])
            # k-th best value per anomaly; everything at or above it (ties included) is sorted exactly
            kth = -np.partition(-sim, kk - 1, axis=1)[:, kk - 1]
            for i in range(len(ids)):
                sel = np.nonzero((sim[i] >= kth[i]) & np.isfinite(sim[i]))[0]
                if sel.size == 0:
                    continue
                s_sel = sim[i, sel]
                order = np.lexsort((cid[sel], -s_sel))[:k]  # similarity desc, then earliest
                out_a.append(np.full(order.size, ids[i]))
                out_c.append(cid[sel][order])
                out_s.append(s_sel[order])
        if not out_a:
            return none
        return pd.DataFrame({"anomaly_id": np.concatenate(out_a).astype("int64"),
                             "context_id": np.concatenate(out_c).astype("int64"),
                             "similarity": np.concatenate(out_s)})
    return run


def _block_options(k: int, earlier_only: bool, step: int = 512):
    """Of a tile the candidates of each class of equal vectors that some anomaly of the class may choose: those
    of an id below the greatest (``_id``) that fewer than ``k`` earlier candidates of the tile equal or beat; where the class has one
    anomaly, or ids don't matter, the ``k`` best."""
    def run(key, anomalies: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"_vh1": [], "_vh2": [], "context_id": [], "similarity": []})
        if anomalies.empty or cands.empty:
            return none
        unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x),
                                   where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
        cands = cands.sort_values("context_id", kind="stable")
        cv, cid = unit(np.asarray(cands["_cvec"].tolist(), dtype=np.float64)), cands["context_id"].to_numpy()
        vecs, last, n = anomalies["_avec"].tolist(), anomalies["_id"].to_numpy(), anomalies["_n"].to_numpy()
        rows, cols, sims = [], [], []
        for lo in range(0, len(vecs), step):  # a strip of the tile at a time
            strip = np.round(unit(np.asarray(vecs[lo:lo + step], dtype=np.float64)) @ cv.T, SIM_DIGITS)
            for i, sim in enumerate(strip, lo):
                if earlier_only:
                    sim = sim[:np.searchsorted(cid, last[i], "left")]
                if earlier_only and n[i] > 1:
                    best, sel, at, size = [], [], 0, 64
                    while at < len(sim):  # pieces double, so few rows beyond the best so far are looked at one by one
                        piece = sim[at:at + size]
                        for j in np.flatnonzero(piece > best[0]) if len(best) == k else range(len(piece)):
                            if len(best) < k:
                                heapq.heappush(best, piece[j])
                            elif piece[j] > best[0]:
                                heapq.heapreplace(best, piece[j])
                            else:
                                continue
                            sel.append(at + int(j))
                        at, size = at + size, 2 * size
                elif len(sim):
                    kk = min(k, len(sim))
                    # everything at or above the k-th best value (ties included) is sorted exactly
                    sel = np.flatnonzero(sim >= -np.partition(-sim, kk - 1)[kk - 1])
                    sel = sel[np.lexsort((cid[sel], -sim[sel]))[:k]]
                else:
                    continue
                rows.append(np.full(len(sel), i))
                cols.append(np.asarray(sel, np.int64))
                sims.append(sim[cols[-1]])
        if not rows:
            return none
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        return pd.DataFrame({"_vh1": anomalies["_vh1"].to_numpy()[rows], "_vh2": anomalies["_vh2"].to_numpy()[rows],
                             "context_id": cid[cols].astype("int64"), "similarity": np.concatenate(sims)})
    return run


_OPTION_SCHEMA = T.StructType([
    T.StructField("_vh1", T.LongType()), T.StructField("_vh2", T.LongType()),
    T.StructField("context_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
])


def far_semantic(df: DataFrame, k: int = 5, vec_col: str = "embedding", earlier_only: bool = True,
                 id_col: str = "LineId", pos_col: str = "pos", flag_col: str = "anomaly",
                 block: int = 16384, text_vectors: DataFrame | None = None, text_col: str = "message") -> DataFrame:
    """Top ``k`` earlier rows (smaller id) by cosine of dense vectors.

    Equal vectors are one class of which only the ``k`` rows of least id can be chosen, and whose anomalies choose from
    the same candidates but for the limit on ids: a class is compared once, however often its line is repeated; this is exact.
    What is left is compared exactly, in bounded tiles: candidates and the last anomalies of the classes are ranked by id, and a tile
    joins the classes of one block of ``block`` ranks with the candidates of one block. With ``earlier_only`` a tile whose candidates all have
    a greater id than its anomalies is not built (about half of the work); whether a row counts as
    earlier depends on ids alone, at every size. A tile emits the candidates that an anomaly of the class can choose
    (``_not_beaten``), each anomaly row takes the best ``k`` of those before it, and a final ``row_number() <= k`` keeps the top of repeated ids.

    ``text_vectors`` (``_t``, ``vec_col``: one vector for each text) is for rows that carry no vectors: they meet
    theirs by ``text_col``, and only the distinct ones are moved.
    """
    cls = ["_vh1", "_vh2"]
    hashes = [F.xxhash64("_vec").alias("_vh1"), F.xxhash64(F.lit(1), "_vec").alias("_vh2")]
    vec = F.col(vec_col).cast("array<double>").alias("_vec")
    own = [F.col(id_col).alias("_id"), F.coalesce(F.col(flag_col), F.lit(False)).alias("_flag")]
    if text_vectors is None:
        base = df.where(F.col(vec_col).isNotNull()).select(*own, vec)
        rows, vectors = base.select("_id", "_flag", *hashes), base.select(*hashes, "_vec")
    else:
        given = materialise(text_vectors.where(F.col(vec_col).isNotNull()).select("_t", vec).select("_t", *hashes, "_vec"))
        rows = df.select(*own, F.col(text_col).alias("_t")).join(given.drop("_vec"), "_t").drop("_t")
        vectors = given.drop("_t")
    rows = materialise(rows)
    vectors = materialise(vectors.dropDuplicates(cls))
    flagged = rows.where(F.col("_flag") & F.col("_id").isNotNull()).drop("_flag")
    chosen = (rows.drop("_flag").withColumn("_nth", F.row_number().over(Window.partitionBy(*cls).orderBy("_id")))
              .where(F.col("_nth") <= k).select("_id", *cls, F.lit(0).cast("long").alias("_n")))
    asked = flagged.groupBy(*cls).agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n")).select("_id", *cls, "_n")
    sides = chosen.unionByName(asked)  # _n: anomalies of a class, 0 for a candidate
    if earlier_only:
        # ids are compared as they are: a rank by id is the same order at every size
        sides = with_position(sides, "_id", out="_rank")
        blk = F.floor(F.col("_rank") / F.lit(block)).cast("int")
        last = sides.agg(F.max("_rank").alias("m")).first()["m"]
        nb = 0 if last is None else int(last) // block + 1
        a_side = F.explode(F.sequence(F.lit(0), blk))
        c_side = F.explode(F.sequence(blk, F.lit(max(nb - 1, 0))))
    else:
        sides = materialise(sides)
        nb = max(1, math.ceil(sides.count() / block))
        blk = F.pmod(F.xxhash64("_id"), F.lit(nb)).cast("int")
        a_side = c_side = F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
    # fresh column identities on both sides: they come from one table
    held = sides.join(vectors, cls)
    a = held.where("_n > 0").select("_id", "_n", *cls, F.col("_vec").alias("_avec"), blk.alias("_ab"), a_side.alias("_cb"))
    c = held.where("_n = 0").select(
        F.col("_id").alias("context_id"), F.col("_vec").alias("_cvec"), c_side.alias("_ab"), blk.alias("_cb"))
    local = (a.groupBy("_ab", "_cb").cogroup(c.groupBy("_ab", "_cb"))
             .applyInPandas(_block_options(k, earlier_only), _OPTION_SCHEMA))
    options = (_not_beaten(local, cls, "similarity", k, earlier_only).groupBy(*cls)
               .agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("_less"), "context_id"))).alias("_options")))
    pairs = flagged.withColumnRenamed("_id", "anomaly_id").join(materialise(options), cls)
    before = F.filter("_options", lambda o: o["context_id"] < F.col("anomaly_id")) if earlier_only else F.col("_options")
    pairs = (pairs.select("anomaly_id", F.explode(F.slice(before, 1, k)).alias("_o"))
             .select("anomaly_id", "_o.context_id", (-F.col("_o._less")).alias("similarity")))
    top = _top_k(pairs, k)
    if id_col == pos_col:
        top = top.withColumns({"anomaly_pos": F.col("anomaly_id"), "context_pos": F.col("context_id")})
    else:
        pos = df.select(F.col(id_col).alias("_id"), F.col(pos_col).alias("_pos"))
        top = (top.join(pos.select(F.col("_id").alias("anomaly_id"), F.col("_pos").alias("anomaly_pos")), "anomaly_id")
               .join(pos.select(F.col("_id").alias("context_id"), F.col("_pos").alias("context_pos")), "context_id"))
    return top.select("anomaly_id", "anomaly_pos", "context_id", "context_pos", F.lit("semantic").alias("kind"),
                      F.col("rank").cast("int"), "similarity")


def _edge_schema() -> T.StructType:
    return T.StructType([
        T.StructField("anomaly_id", T.LongType()), T.StructField("anomaly_pos", T.LongType()),
        T.StructField("context_id", T.LongType()), T.StructField("context_pos", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("rank", T.IntegerType()),
        T.StructField("similarity", T.DoubleType()),
    ])


def far_hybrid(df: DataFrame, k: int = 5, text_col: str = "message", vec_col: str = "embedding",
               id_col: str = "LineId", pos_col: str = "pos", flag_col: str = "anomaly",
               text_vectors: DataFrame | None = None) -> DataFrame:
    """Union (not fusion) of the semantic and the lexical top ``k``; a row may come twice.
    Anomalies without a vector get the lexical edges only."""
    sem = far_semantic(df, k, vec_col, True, id_col, pos_col, flag_col, text_vectors=text_vectors, text_col=text_col)
    lex = far_lexical(df, k, True, text_col, id_col, pos_col, flag_col)
    return sem.unionByName(lex)


def window_context(df: DataFrame, h: int = 5, threshold: float = 0.79, id_col: str = "LineId",
                   score_col: str = "anomaly_score") -> DataFrame:
    """Fallback context: each row refers to the last anomaly (by id) within ``h`` ids,
    context ids clipped to ``1..n``; an anomaly always refers to itself or a later one.

    Returns ``(LineId, context_ids_ref)``: fan-out to ``2h+1`` ids and an
    equi-join, then ``max``; the same as a range window of +-h over ids, without
    a global sort.
    """
    n = df.count()
    a = df.where(F.col(score_col) >= F.lit(threshold)).select(F.col(id_col).alias("_a"))
    fan = (a.select("_a", F.explode(F.sequence(F.col("_a") - h, F.col("_a") + h)).alias("_ctx"))
           .where((F.col("_ctx") == F.col("_a")) | F.col("_ctx").between(1, n)))
    best = fan.groupBy("_ctx").agg(F.max("_a").alias("_a"))
    out = df.join(best, df[id_col] == best["_ctx"], "left")
    return out.withColumn("context_ids_ref", F.col("_a").cast("string")).drop("_ctx", "_a")


def self_edges(df: DataFrame, id_col: str = "LineId", pos_col: str = "pos", flag_col: str = "anomaly") -> DataFrame:
    a = _anomalies(df, id_col, pos_col, flag_col)
    return a.select("anomaly_id", "anomaly_pos", F.col("anomaly_id").alias("context_id"),
                    F.col("anomaly_pos").alias("context_pos"), F.lit("self").alias("kind"),
                    F.lit(0).alias("rank"), F.lit(None).cast("double").alias("similarity"))


def kept_edges(edges: DataFrame, df: DataFrame, id_col: str = "LineId", pos_col: str = "pos",
               flag_col: str = "anomaly", compat: bool = True) -> DataFrame:
    """Edges as they survive in the per-row lists, self edges included.

    ``compat``: an anomaly's own list is reset when it is processed (in position
    order), so edges into it from earlier anomalies are lost.
    """
    e = edges.select(*EDGE_COLUMNS).unionByName(self_edges(df, id_col, pos_col, flag_col))
    if compat:
        flags = df.where(F.col(flag_col) == F.lit(True)).select(F.col(id_col).alias("context_id"),
                                                                 F.lit(True).alias("_ctx_is_anomaly"))
        e = e.join(flags, "context_id", "left")
        e = e.where(~(F.col("_ctx_is_anomaly").isNotNull() & (F.col("anomaly_pos") < F.col("context_pos"))))
        e = e.drop("_ctx_is_anomaly")
    return e


def _kind_no(kind):
    expr = F.lit(9)
    for name, no in sorted(KIND_ORDER.items(), key=lambda kv: -kv[1]):
        expr = F.when(kind == name, F.lit(no)).otherwise(expr)
    return expr


def context_ids(edges: DataFrame, df: DataFrame, id_col: str = "LineId", pos_col: str = "pos",
                flag_col: str = "anomaly", compat: bool = True, out: str = "context_ids",
                bucket_rows: int = 1 << 20, name_col: str | None = None) -> DataFrame:
    """Render the per-row list of anomaly ids (``"5,9"``), in processing order:
    anomaly position, then near before semantic before lexical, then rank.
    ``compat=False`` keeps edges into anomalies and removes repeated ids.

    A popular row (e.g. the earliest copy of a frequent message) can be context
    for a great many anomalies. Its list is built in two steps: ordered partial
    lists per (row, block of ``bucket_rows`` anomaly positions), spread over tasks,
    then a concatenation of the few partials in block order. ``name_col`` names the column whose values are
    listed, where rows are keyed by another one."""
    e = kept_edges(edges, df, id_col, pos_col, flag_col, compat)
    if name_col is not None and name_col != id_col:
        names = df.where(F.col(flag_col) == F.lit(True)).select(F.col(id_col).alias("anomaly_id"), F.col(name_col).alias("_name"))
        e = e.join(names, "anomaly_id").withColumn("anomaly_id", F.col("_name"))
    e = e.select("context_id", F.floor(F.col("anomaly_pos") / F.lit(bucket_rows)).alias("_b"),
                 F.struct("anomaly_pos", _kind_no(F.col("kind")).alias("kind_no"), "rank", "anomaly_id").alias("_e"))
    ids = F.transform(F.sort_array(F.collect_list("_e")), lambda x: x["anomaly_id"].cast("string"))
    if not compat:
        ids = F.array_distinct(ids)  # repeats come from one anomaly, hence one block
    part = e.groupBy("context_id", "_b").agg(F.array_join(ids, ",").alias("_s"))
    lists = part.groupBy("context_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_b", "_s"))), lambda x: x["_s"]), ",").alias(out))
    lists = lists.withColumnRenamed("context_id", "_cid")
    return df.join(lists, df[id_col] == lists["_cid"], "left").drop("_cid")


def gather_context(edges: DataFrame, df: DataFrame, rendered: str = "_row", id_col: str = "LineId",
                   pos_col: str = "pos", flag_col: str = "anomaly", mode: str = "member",
                   compat: bool = True) -> DataFrame:
    """Context rows of each anomaly, in table order: ``(anomaly_id, context_rows[])``.

    ``member``: rows whose list holds the anomaly id. ``exact``: rows whose whole
    list equals the id. The group of one anomaly is bounded by its edges
    (1 + near + far), so the ordered collect is bounded.
    """
    e = kept_edges(edges, df, id_col, pos_col, flag_col, compat)
    if mode == "exact":
        sizes = e.groupBy("context_id").agg(F.count(F.lit(1)).alias("_n"))
        e = e.join(sizes.where(F.col("_n") == 1).select("context_id"), "context_id", "left_semi")
    else:
        e = e.select("anomaly_id", "context_id", "context_pos").dropDuplicates(["anomaly_id", "context_id"])
    rows = df.select(F.col(id_col).alias("context_id"), F.col(rendered).alias("_txt"))
    g = e.select("anomaly_id", "context_id", "context_pos").join(rows, "context_id")
    return g.groupBy("anomaly_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("context_pos", "context_id", "_txt"))),
                    lambda x: x["_txt"]).alias("context_rows"))
