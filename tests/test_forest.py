"""Isolation forest scores recomputed row by row from the stored trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logscope.operators import detect

SCHEMA = "LineId long, file string, x double, y double, words array<string>"


def rows(n=400):
    rng = random.Random(4)
    out = []
    for i in range(n):
        f = "hot" if i % 3 else f"file{i % 5}"
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 6))]
        out.append((i, f, rng.gauss(0, 1), float(rng.randint(0, 3)), words if i % 7 else None))
    return out + [(9000, "hot", 40.0, 90.0, ["odd"] * 9), (9001, "never fitted", 0.0, 0.0, ["a"]), (9002, None, 0.0, 0.0, [])]


def c(n):
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def walked(trees, numbers, words):
    """Mean path of one row, node by node."""
    total = 0.0
    for t in trees:
        at, depth = 0, 0
        while t["feature"][at] != -1:
            value = words.count(t["word"][at]) if t["feature"][at] == -2 else numbers[t["feature"][at]]
            at = t["left"][at] if value < t["threshold"][at] else t["right"][at]
            depth += 1
        total += depth + c(t["size"][at])
    return 2.0 ** -(total / len(trees) / c(max(t["size"][0] for t in trees)))


@pytest.mark.parametrize("nodes", [detect.BROADCAST_NODES, 0])
def test_scores_follow_from_the_stored_trees(spark, monkeypatch, nodes):
    monkeypatch.setattr(detect, "BROADCAST_NODES", nodes)
    monkeypatch.setattr(detect, "TILE", 4)  # several tiles in the hot file
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    train = df.where("LineId < 400")
    forest = detect.fit_forest(train, ["x", "y"], 12, 32, 3, by="file", words_col="words")
    by_file = {}
    for t in forest.collect():
        by_file.setdefault(t["_f"], []).append(t)
    assert set(by_file) == {r[1] for r in data if r[0] < 400} and all(len(t) == 12 for t in by_file.values())
    names = sorted({w for r in data for w in r[4] or []})
    code = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r["_id"]: r["pred_ano_proba"] for r in detect.score_forest(df, forest, ["x", "y"], by="file", words_col="words").collect()}
    for i, f, x, y, words in data:
        if f in by_file:
            assert abs(got[i] - walked(by_file[f], [x, y], [code[w] for w in words or []])) < 1e-9, i
    out = {r["LineId"]: r for r in detect.isolation_forest(df.where("LineId >= 9000"), df, ["x", "y"], 5, 8, by="file", words_col="words").collect()}
    assert len(out) == len(data) and out[9002]["pred_ano_proba"] is None and out[9002]["pred_ano"] == 0
    assert out[0]["pred_ano_proba"] is None and out[9001]["pred_ano_proba"] == 0.5  # one train row


def test_broadcast_scoring_has_no_shuffle(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    forest = detect.fit_forest(df, ["x", "y"], 3, 16, by="file", words_col="words")
    plan = detect.score_forest(df, forest, ["x", "y"], by="file", words_col="words")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_empty_tables(spark):
    df = spark.createDataFrame(rows(30), SCHEMA)
    assert detect.isolation_forest(df, df.limit(0), ["x"], 3, 8, by="file").count() == 0
    out = detect.isolation_forest(df.limit(0), df, ["x"], 3, 8, by="file").collect()
    assert len(out) == 33 and all(r["pred_ano_proba"] is None and r["pred_ano"] == 0 for r in out)
