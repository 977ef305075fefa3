"""Work that grows with the input and no faster: what steps move, write and compare, with results as plain models give them."""

import time

import numpy as np
from pyspark.sql import functions as F

from logscope.functions import text as txt
from logscope.operators import context as ctx
from logscope.operators import detect
from logscope.operators.vectors import features
from logscope.plans import catalog, files, pipeline
from logscope.operators.position import with_position


def test_trigrams_of_a_long_text_take_one_pass(spark):
    long = "ab😀é\n" * 25_000
    texts = [long, "abc", "ab", "", None, "a\r\n \x85b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    since = time.monotonic()
    got = {r["i"]: r["g"] for r in df.select("i", txt.trigrams(F.col("t")).alias("g")).collect()}
    assert time.monotonic() - since < 30
    assert got == {i: [t[j:j + 3] for j in range(len(t) - 2)] if t else [] for i, t in enumerate(texts)}


def test_feature_vectors_are_sparse_and_the_vocabulary_a_table(spark):
    rows = [(i, [f"req{i}", "GET", "GET", f"item{i % 7}"] if i % 9 else [], float(i % 3), None if i == 4 else 1.5) for i in range(200)]
    df = spark.createDataFrame(rows * 2, "i int, e_words array<string>, a double, b double")
    (out,) = features(df.where("i < 50"), [df], numeric_cols=("a", "b"))
    assert not out.schema["features"].metadata  # it listed every word
    counts = {}
    for i, words, _, _ in rows[:50]:
        for w in words:
            counts[w] = counts.get(w, 0) + 2
    place = {w: p for p, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
    found = out.select("i", "features").collect()
    assert len(found) == 400
    for r in found:
        _, words, a, b = rows[r["i"]]
        want = np.zeros(len(place) + 2)
        for w in words:
            if w in place:
                want[place[w]] += 1
        want[-2:] = a, np.nan if b is None else b
        assert r["features"].size == len(want) and len(r["features"].values) < 8
        np.testing.assert_array_equal(r["features"].toArray(), want)


def test_features_query_makes_no_dense_rows(spark, monkeypatch):
    rows = [("f", i, [f"req{i}", "GET"], 2, 1, 8, 1, 8, i) for i in range(300)]
    names = "source_file string, line_no long, e_words array<string>, e_words_len int, e_trigrams_len int, e_chars_len int, e_lines_len int, e_event_id_len int, _line_key long"
    df = spark.createDataFrame(rows, names)
    monkeypatch.setattr(catalog, "_enhanced", lambda spark, sf: df)
    out = catalog.q_features(spark, "")
    assert "vector_to_array" not in out._jdf.queryExecution().analyzed().toString().lower()
    train = {r["line_no"] for r in detect.split(df, 0.9, 42, ["_line_key"])[0].collect()}
    for r in out.collect():
        assert r["dims"] == len(train) + 1 + 5 and r["total"] == 20 + 1 + (r["line_no"] in train)


def test_semantic_context_compares_equal_vectors_once(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    base = rnd.integers(-3, 4, size=(9, 3)).astype(float)
    of = rnd.integers(0, 9, size=600)
    rows = [(i, base[v].tolist(), bool(rnd.random() < 0.5)) for i, v in enumerate(of)]
    df = with_position(spark.createDataFrame(rows, "LineId long, embedding array<double>, anomaly boolean"), "LineId")
    options = []
    whole = ctx._not_beaten
    monkeypatch.setattr(ctx, "_not_beaten", lambda d, *a: options.append(d) or whole(d, *a))
    unit = np.divide(base, np.linalg.norm(base, axis=1, keepdims=True), out=np.zeros_like(base), where=np.linalg.norm(base, axis=1, keepdims=True) > 0)
    sim = np.round(unit @ unit.T, 12)
    for earlier in (True, False):
        for block in (16384, 11):
            got = {}
            for r in ctx.far_semantic(df, 4, earlier_only=earlier, block=block).collect():
                got.setdefault(r["anomaly_id"], []).append((r["rank"], r["context_id"], round(r["similarity"], 9)))
            for i, _, flag in rows:
                if flag:
                    best = sorted((-sim[of[i], of[j]], j) for j in range(i if earlier else 600))[:4]
                    assert sorted(got.get(i, [])) == [(n, j, round(-s, 9)) for n, (s, j) in enumerate(best, 1)]
    assert options and options[0].count() <= 9 * 9 * 4  # not by the anomaly rows


def test_embedded_lines_carry_no_vectors(spark, monkeypatch):
    rows = [(i, f"disk {i % 4} failed", 0.9 if i % 3 == 0 else 0.1) for i in range(1, 40)] + [(40, None, 0.9)]
    df = spark.createDataFrame(rows, "LineId long, message string, anomaly_score double")
    seen = []
    whole = ctx.far_semantic
    monkeypatch.setattr(ctx, "far_semantic", lambda d, *a, **kw: seen.append(d.columns) or whole(d, *a, **kw))
    given = pipeline.explain_lines(pipeline.prepare(df), pipeline.LineConfig(strategy="semantic"))
    from logscope.operators.vectors import embed
    carried = pipeline.explain_lines(embed(pipeline.prepare(df)), pipeline.LineConfig(strategy="semantic"))
    assert "embedding" not in seen[0] and "embedding" in seen[1]
    cols = ["LineId", "context_ids_ref", "anomaly_label", "explanation_prompt"]
    cols = [c for c in cols if c in given.columns]
    assert sorted(map(str, given.select(cols).collect())) == sorted(map(str, carried.select(cols).collect()))


def test_scored_files_are_written_without_features(spark, monkeypatch):
    rows = [(f"f{i % 2}", i, f"10:00:{i % 60:02d}.000 [w-{i % 3}] req{i} DEBUG a.B <init> - took {i}") for i in range(120)]
    raw = spark.createDataFrame(rows, "source_file string, line_no long, value string")
    written = []
    whole = files.materialise
    monkeypatch.setattr(files, "materialise", lambda d: written.append(d.columns) or whole(d))
    out = files.explain_files(raw, files.FileConfig(token_limit=200)).collect()
    assert len(out) == 2 and written and not any(c.startswith("e_") for cols in written for c in cols)


def test_svm_steps_read_distinct_rows(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 4, size=(500, 2)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "LineId long, x double, y double").repartition(3)
    read = []
    whole = detect.materialise
    monkeypatch.setattr(detect, "materialise", lambda d: read.append(whole(d)) or read[-1])
    got = {r["LineId"]: r["pred_ano_proba"] for r in detect.one_class_svm(df, df, ["x", "y"], nu=0.1, iters=20).collect()}
    assert read[0].count() == len(np.unique(x, axis=0)) == 16
    rng = np.random.default_rng(42)
    W, b = rng.normal(scale=np.sqrt(2 / (2 * x.var())), size=(2, 256)), rng.uniform(0, 2 * np.pi, size=256)
    phi, w, rho = np.sqrt(2 / 256) * np.cos(x @ W + b), np.zeros(256), 0.0
    for _ in range(20):
        viol = phi @ w < rho
        w, rho = w - 0.1 * (w - phi[viol].sum(0) / 50), rho - 0.1 * (-1 + viol.sum() / 50)
    np.testing.assert_allclose([got[i] for i in range(500)], rho - phi @ w, atol=1e-9)
