"""Nearest neighbours by pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logscope.operators import detect
from logscope.session import materialise

SCHEMA = "_f string, _id long, _x array<double>, _w array<long>"


def frame(spark, rows):
    return materialise(spark.createDataFrame(rows, SCHEMA).repartition(4))


def all_pairs(queries, points, k, exclude_self):
    words = sorted({w for r in queries + points for w in r[3]})

    def vec(r):
        return np.array([*r[2], *(r[3].count(w) for w in words)])
    out = {}
    for q in queries:
        near = sorted((round(float(np.linalg.norm(vec(q) - vec(p))), 9), p[1]) for p in points if p[0] == q[0] and not (exclude_self and p[1] == q[1]))
        out[q[0], q[1]] = near[:k]
    return {a: v for a, v in out.items() if v}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["_f"], r["_q"]), []).append((round(r["_d"], 9), r["_o"]))
    return {a: sorted(v) for a, v in out.items()}


@pytest.mark.parametrize("exclude_self", [False, True])
def test_same_as_all_pairs(spark, monkeypatch, exclude_self):
    """Groups of any size, repeated points, ties, queries far away, a group without points; cells and tiles of a few rows."""
    monkeypatch.setattr(detect, "CELL", 12)
    rng = np.random.default_rng(5)

    def rows(n, first, spread):
        return [(rng.choice(["a", "a", "b"]), first + i, [float(v) for v in rng.integers(0, spread, 2)], [int(w) for w in rng.integers(0, 4, rng.integers(0, 3))])
                for i in range(n)]
    points = rows(150, 0, 9) + [("a", 1000 + i, [3.0, 3.0], [1]) for i in range(30)] + [("c", 5, [0.0, 0.0], [])]
    queries = points if exclude_self else rows(60, 2000, 12) + [("a", 3000, [500.0, -3.0], [9, 9]), ("none", 1, [0.0, 0.0], [])]
    got = found(detect.knn(frame(spark, queries), frame(spark, points), 4, exclude_self, tile=8))
    assert got == all_pairs(queries, points, 4, exclude_self)


def test_far_fewer_pairs_and_empty(spark):
    """Lines of many kinds: a query meets its own kind only."""
    rng = np.random.default_rng(8)
    centres = rng.normal(scale=50, size=(40, 3))
    rows = [("f", i, [float(v) for v in centres[i % 40] + rng.normal(size=3)], []) for i in range(12_000)]
    points, queries = frame(spark, rows[:6000]), frame(spark, rows[6000:])
    pairs = detect.compared_pairs(queries, points, 5)
    assert pairs < 0.4 * 6000 * 6000, pairs
    none = points.where(F.lit(False))
    assert detect.knn(none, points, 3).count() == 0 and detect.knn(queries, none, 3).count() == 0
