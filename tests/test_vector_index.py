"""Inverted lists against the exact tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logscope.operators import vector_index as vi
from logscope.operators.context import far_semantic
from logscope.session import materialise


def frame(spark, x, flags):
    return materialise(spark.createDataFrame([(i, i, [float(v) for v in r], bool(f)) for i, (r, f) in enumerate(zip(x, flags, strict=True))],
                                 "LineId long, pos long, embedding array<double>, anomaly boolean").repartition(6))


def edges(df):
    return {(r["anomaly_id"], r["context_id"]): (r["rank"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    """Groups of related vectors with their own spread, as message embeddings are; a third of all rows in one dense group."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(300, 24))
    own = np.where(rng.random(6000) < 0.33, 0, rng.integers(0, 300, 6000))
    return centres[own] + 0.35 * rng.normal(size=(6000, 24)), rng.random(6000) < 0.05


def test_recall_and_pairs(spark, clustered):
    x, flags = clustered
    df = frame(spark, x, flags)
    exact = edges(far_semantic(df, 5))
    got = edges(vi.far_semantic_index(df, 5, list_rows=64, probes=8))
    per = {a for a, _ in exact}
    assert {a for a, _ in got} == per and len(got) == len(exact)  # no anomaly has fewer edges
    recall = len(exact.keys() & got.keys()) / len(exact)
    assert recall >= 0.9, recall
    assert all(got[e][1] == exact[e][1] for e in exact.keys() & got.keys())
    rows = df.select(F.col("LineId").alias("_id"), F.col("embedding").alias("_vec"), F.col("anomaly").alias("_flag"))
    half = rows.where("_id < 3000")
    pairs = {n: vi.pairs_compared(d, vi.fit_index(d.select("_id", "_vec"), 64), 8) / d.where("_flag").count() for n, d in ((3000, half), (6000, rows))}
    assert pairs[6000] < 6000 * 0.5 and pairs[6000] < 2.2 * pairs[3000]


def test_two_levels_and_all_lists(spark, clustered, monkeypatch):
    x, flags = clustered
    x, flags = x[:1500], flags[:1500]
    df = frame(spark, x, flags)
    exact = edges(far_semantic(df, 3))
    assert edges(vi.far_semantic_index(df, 3, list_rows=500, probes=8)) == exact  # all lists looked into
    monkeypatch.setattr(vi, "MOST_CENTRES", 8)
    monkeypatch.setattr(vi, "TILE_ROWS", 100)
    got = edges(vi.far_semantic_index(df, 3, list_rows=32, probes=12))
    assert len(exact.keys() & got.keys()) / len(exact) >= 0.9


def test_code_book_lists_are_distinct():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    old, vi.MOST_CENTRES = vi.MOST_CENTRES, 8
    try:
        book = vi.CodeBook(x, 40, 3)
    finally:
        vi.MOST_CENTRES = old
    lists = book.lists(x, 10)
    assert len(book.fine) == 5 and lists.max() < 40
    assert all(len(set(r)) == len(r) for r in lists.tolist())


def test_copies_zero_vectors_and_empty(spark):
    x = np.array([[1.0, 0.0]] * 40 + [[0.0, 0.0]] * 5 + [[0.0, 1.0], [1.0, 1.0]])
    df = frame(spark, x, [True] * len(x))
    assert edges(vi.far_semantic_index(df, 3, list_rows=4, probes=2)).keys() == edges(far_semantic(df, 3)).keys()
    assert vi.far_semantic_index(df.where("LineId < 0"), 3).count() == 0
    assert vi.far_semantic_index(df.withColumn("embedding", F.lit(None).cast("array<double>")), 3).count() == 0
