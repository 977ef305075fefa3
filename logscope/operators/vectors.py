"""Text vectors (CTX8) and feature vectors (FEA5)."""

from __future__ import annotations

import re
import zlib
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.operators.position import with_position
from logscope.session import materialise

_WORD = re.compile(r"(?u)\b\w\w+\b")


class HashingEncoder:
    """Offline default encoder: hashed bag of words, L2-normalised (no model weights needed)."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()):
                out[i, zlib.crc32(w.encode("utf-8")) % self.dim] += 1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def embed_texts(df: DataFrame, col: str = "message", out: str = "embedding",
                encoder: Callable[[], object] = HashingEncoder) -> DataFrame:
    """``_t`` and its vector, one row for each distinct text. Texts are encoded in Arrow batches, with one encoder
    per Python worker (``encoder`` is a zero-argument factory with ``encode(list) -> ndarray``)."""
    holder: dict = {}

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _enc(s: pd.Series) -> pd.Series:
        if "e" not in holder:
            holder["e"] = encoder()
        vecs = holder["e"].encode(s.fillna("").tolist())
        return pd.Series([v.astype(np.float32).tolist() for v in vecs])

    texts = df.select(F.col(col).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    return texts.withColumn(out, _enc(F.col("_t")))


def embed(df: DataFrame, col: str = "message", out: str = "embedding",
          encoder: Callable[[], object] = HashingEncoder) -> DataFrame:
    """Text -> vector. Distinct texts are encoded once (``embed_texts``)
    and joined back: repeated log lines cost nothing."""
    vecs = embed_texts(df, col, out, encoder)
    return df.join(vecs, df[col] == vecs["_t"], "left").drop("_t")


# The most frequent words are broadcast, so a word of nearly every row moves no rows; the others meet theirs by a shuffle.
HEAD_WORDS = 4096


def _vector(size: int):
    """Sorted word places (repeats kept) and the numbers as one vector of ``size``, stored as MLlib would (the smaller form)."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    @F.udf(VectorUDT())
    def build(places, numbers):
        at, times = np.unique(np.asarray(places or [], np.int64), return_counts=True)
        num = np.asarray([np.nan if v is None else v for v in numbers], np.float64)
        held = np.flatnonzero(num)
        at, values = np.concatenate([at, held + size - len(num)]), np.concatenate([times.astype(np.float64), num[held]])
        if 1.5 * (len(at) + 1.0) < size:
            return Vectors.sparse(size, at, values)
        dense = np.zeros(size)
        dense[at] = values
        return Vectors.dense(dense)
    return build


def features(train: DataFrame, frames: Sequence[DataFrame], words_col: str = "e_words",
             numeric_cols: Sequence[str] = ("e_words_len", "e_trigrams_len", "e_chars_len", "e_lines_len",
                                            "e_event_id_len"),
             vocab_size: int | None = None, min_df: float = 1.0, out: str = "features") -> list[DataFrame]:
    """Word counts (vocabulary fitted on ``train``) plus numeric columns as one vector. All words of
    ``train`` count; ``vocab_size`` keeps only the most frequent ones where that is wanted.

    The vocabulary grows with ``train`` (ids and addresses are words), so it is a table: words in order of their counts, the most
    frequent first. Distinct word lists are exploded, joined with it, gathered to the places of their words, and joined back. Vectors are sparse."""
    held = train.select(F.explode(words_col).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_c"))
    if min_df != 1.0:
        least = min_df if min_df >= 1.0 else min_df * train.count()
        rows = train.select(F.explode(F.array_distinct(words_col)).alias("_w")).groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
        held = held.join(rows.where(F.col("_df") >= least).select("_w"), "_w")
    vocabulary = with_position(held.withColumn("_less", -F.col("_c")), ["_less", "_w"], out="_i")
    if vocab_size:
        vocabulary = vocabulary.where(F.col("_i") < vocab_size)
    vocabulary = materialise(vocabulary.select("_w", "_i"))
    size = vocabulary.count()
    if not size:
        raise ValueError("no word of the train rows is in the vocabulary")
    head, tail = F.broadcast(vocabulary.where(F.col("_i") < HEAD_WORDS)), vocabulary.where(F.col("_i") >= HEAD_WORDS)
    key = ["_k1", "_k2"]
    keys = {"_k1": F.xxhash64(words_col), "_k2": F.xxhash64(F.lit(1), words_col)}
    build = _vector(size + len(numeric_cols))
    numbers = F.array(*[F.col(c).cast("double") for c in numeric_cols])
    done = []
    for f in frames:
        lists = f.withColumns(keys).select(*key, F.col(words_col).alias("_words")).dropDuplicates(key)
        pairs = lists.select(*key, F.explode("_words").alias("_w")).join(head, "_w", "left")
        pairs = materialise(pairs)
        rare = pairs.where("_i is null").drop("_i").join(tail, "_w")
        places = (pairs.where("_i is not null").select(*key, "_i").unionByName(rare.select(*key, "_i"))
                  .groupBy(*key).agg(F.sort_array(F.collect_list("_i")).alias("_places")))
        x = f.withColumns(keys).join(places, key, "left")
        done.append(x.withColumn(out, build("_places", numbers)).drop("_k1", "_k2", "_places"))
    return done
