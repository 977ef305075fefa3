import random
import sys

import numpy as np
from pyspark.sql import functions as F

from logscope.operators import budget
from logscope.operators import detect
from logscope.operators import inference as inf
from logscope.operators import templates as tpl
from logscope.operators.prepare import sample_n, sample_per_group
from tests.models import iterative_trim

from pyspark import cloudpickle

# test-local clients and helpers are shipped to the Python workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_split_is_deterministic(spark):
    df = spark.range(1, 2001).withColumnRenamed("id", "LineId")
    tr1, te1 = detect.split(df, 0.9, 7)
    tr2, te2 = detect.split(df.repartition(13), 0.9, 7)
    assert sorted(r[0] for r in tr1.collect()) == sorted(r[0] for r in tr2.collect())
    assert tr1.count() + te1.count() == 2000 and 100 < tr1.count() < 320


def test_isolation_forest_ranks_outliers(spark):
    rnd = np.random.default_rng(0)
    pts = rnd.normal(size=(600, 2)).tolist() + [[8.0, 8.0], [-9.0, 7.0]]
    df = spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(pts)], "LineId long, x double, y double")
    out = detect.isolation_forest(df, df, ["x", "y"], trees=50, psi=128, seed=1)
    scores = {r["LineId"]: r["pred_ano_proba"] for r in out.collect()}
    normal = np.median([scores[i] for i in range(1, 601)])
    assert scores[601] > 0.6 and scores[602] > 0.6 and normal < 0.5


def test_detector_auc_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.random() < 0.3, round(rnd.random(), 2)) for i in range(500)]
    df = spark.createDataFrame([(i, a, s, int(s > 0.5)) for i, a, s in rows],
                               "id long, anomaly boolean, pred_ano_proba double, pred_ano int")
    got = detect.detector_metrics(df).collect()[0]
    pos = [s for _, a, s in rows if a]
    neg = [s for _, a, s in rows if not a]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got["auc"] - auc) < 1e-6


def test_trim_policies(spark):
    rnd = random.Random(3)
    rows = [("f", i, rnd.random(), " ".join("w" for _ in range(rnd.randint(1, 30)))) for i in range(400)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, pred_ano_proba double, m_message string")
    order = sorted(rows, key=lambda r: (-r[2], r[1]))
    toks = [len(r[3].split()) for r in order]
    limit = 1500
    prefix = budget.trim_to_budget(df, limit).count()
    n = 0
    while n < len(toks) and sum(toks[: n + 1]) + n <= limit:
        n += 1
    assert prefix == n
    it = budget.trim_to_budget(df, limit, policy="iterative")
    want = iterative_trim(toks, limit)
    assert it.count() == want
    kept = {r["line_no"] for r in it.collect()}
    assert kept == {r[1] for r in order[:want]}


def test_token_count(spark):
    df = spark.createDataFrame([("f", "a b, c"), ("f", "d"), ("g", "x.y")], "source_file string, m_message string")
    got = {r[0]: r[1] for r in budget.token_count(df, by="source_file").collect()}
    assert got == {"f": 4 + 1 + 1, "g": 3}


def make_echo_client():
    # defined in a function so that it is shipped to the workers by value
    class EchoClient:
        def complete(self, prompt, max_tokens):
            if "fail" in prompt:
                raise RuntimeError("boom")
            return f" label for {prompt.split()[-1]} "
    return EchoClient()


def test_complete_and_attach(spark):
    df = spark.createDataFrame([(1, "p memory"), (2, "p memory"), (3, None), (4, "please fail")],
                               "LineId long, prompt string")
    out = {r["LineId"]: r["resp"] for r in inf.complete(df, "prompt", "resp", make_echo_client).collect()}
    assert out == {1: " label for memory ", 2: " label for memory ", 3: None, 4: "Error: boom"}
    resp = spark.createDataFrame([(1, "b"), (1, "a"), (9, "z")], "LineId long, r string")
    got = {r["LineId"]: r["r"] for r in inf.attach(df, resp, "r").collect()}
    assert got == {1: "a", 2: None, 3: None, 4: None}
    files = spark.createDataFrame([("f1", "x ok"), ("f2", ""), ("f3", "fail now")], "f string, file_prompt string")
    fr = {r["f"]: r["file_explanation"] for r in inf.file_responses(files, make_echo_client).collect()}
    assert fr == {"f1": "label for ok", "f2": "Error: Invalid prompt provided.", "f3": "Error: boom"}


def test_templates(spark):
    msgs = ["open file a1 ok", "open file b2 ok", "open file c3 ok", "close port 80", "close port 81"]
    df = spark.createDataFrame([(m,) for m in msgs], "e_message_normalized string")
    ip = {r[0]: r[1] for r in tpl.templates_iplom(df).select("e_message_normalized", "template").collect()}
    assert ip["open file a1 ok"] == "open file <*> ok" and ip["close port 80"] == "close port <*>"
    dr = {r[0]: r[1] for r in tpl.templates_drain(df).select("e_message_normalized", "template").collect()}
    assert dr["open file c3 ok"] == "open file <*> ok"
    sp = {r[0]: r[1] for r in tpl.templates_spell(df).select("e_message_normalized", "template").collect()}
    assert sp["open file a1 ok"] == "open file ok"
    br = tpl.templates_brain(df).where(F.col("template").isNull()).count()
    assert br == 0


def test_sampling_is_reproducible(spark):
    df = spark.range(1, 501).withColumnRenamed("id", "LineId").withColumn("g", F.col("LineId") % 3)
    a = sorted(r[0] for r in sample_n(df, 20, 5).collect())
    b = sorted(r[0] for r in sample_n(df.repartition(7), 20, 5).collect())
    assert a == b and len(a) == 20
    per = sample_per_group(df, "g", 4, 5).groupBy("g").count().collect()
    assert sorted(r["count"] for r in per) == [4, 4, 4]


def test_lof_matches_brute_force(spark):
    rnd = np.random.default_rng(1)
    tr = rnd.normal(size=(120, 3))
    te = np.vstack([rnd.normal(size=(30, 3)), [[6, 6, 6]]])
    a = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(tr)], "LineId long, a double, b double, c double")
    b = spark.createDataFrame([(1000 + i, *map(float, r)) for i, r in enumerate(te)],
                              "LineId long, a double, b double, c double")
    got = {r["LineId"]: r["pred_ano_proba"] for r in detect.lof(a, b, ["a", "b", "c"], 10).collect()}

    def dist(x, y):
        return np.sqrt(((x - y) ** 2).sum(-1))
    d = dist(tr[:, None], tr[None])
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, 1)[:, :10]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, nn, 1), kd[nn]).mean(1) + 1e-10)
    for i, x in enumerate(te):
        dx = dist(x[None], tr)
        n = np.argsort(dx)[:10]
        assert abs(lrd[n].mean() * (np.maximum(dx[n], kd[n]).mean() + 1e-10) - got[1000 + i]) < 1e-9
    assert got[1030] > 1.5


def test_embed_distinct_texts(spark):
    from logscope.operators.vectors import embed
    df = spark.createDataFrame([(1, "disk full"), (2, "disk full"), (3, None)], "LineId long, message string")
    out = {r["LineId"]: r["embedding"] for r in embed(df).collect()}
    assert out[1] == out[2] and abs(sum(v * v for v in out[1]) - 1) < 1e-6 and out[3] is None


def test_label_stream(spark, tmp_path):
    from logscope.streaming.rules import label_stream, write_micro_batches
    src = tmp_path / "in"
    spark.createDataFrame([(1, "out of memory", 0.9, "KERNEL", "n1"), (2, "ok", 0.1, "APP", "n2")],
                          "row_nr long, m_message string, pred_ano_proba double, component string, node string") \
        .write.parquet(str(src))
    stream = spark.readStream.schema("row_nr long, m_message string, pred_ano_proba double, component string, "
                                     "node string").parquet(str(src))
    got = []
    q = write_micro_batches(label_stream(stream), lambda b, _: got.extend(b.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    by = {r["LineId"]: r["anomaly_label_final"] for r in got}
    assert by == {1: "memory", 2: None}


def test_one_class_svm_flags_outliers(spark):
    rnd = np.random.default_rng(2)
    pts = rnd.normal(size=(400, 2)).tolist() + [[7.0, 7.0], [-8.0, 6.0]]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "LineId long, x double, y double")
    out = {r["LineId"]: r for r in detect.one_class_svm(df, df, ["x", "y"], nu=0.1).collect()}
    assert out[400]["pred_ano"] == 1 and out[401]["pred_ano"] == 1
    inliers = sum(out[i]["pred_ano"] == 0 for i in range(400))
    assert inliers > 280


def test_chain_and_columns(spark):
    from logscope.operators.prepare import ensure_columns
    df = spark.createDataFrame([(1, "disk")], "LineId long, m string")
    out = ensure_columns(df, {"m": "string", "context_ids_ref": "string", "anomaly_score": 0.0})
    assert out.columns == ["LineId", "m", "context_ids_ref", "anomaly_score"]
    steps = [(lambda d: d.withColumn("_step0", F.concat(F.lit("first "), "m")), "r1"),
             (lambda d: d.withColumn("_step1", F.concat(F.lit("second "), F.trim("r1"))), "r2")]
    r = inf.chain(df, steps, make_echo_client).collect()[0]
    assert r["r1"] == " label for disk " and r["r2"] == " label for disk "


def make_label_client():
    class LabelClient:
        def complete(self, prompt, max_tokens):
            line = prompt.split("Anomalous line:\n")[1].split("\n")[0]
            if "Anomaly Label:" in prompt:
                if "timeout" in line:
                    raise RuntimeError("down")
                return "The cause is likely the component shown."
            return "Network" if "timeout" in line else "memory"
    return LabelClient()


def test_explain_lines_with_client(spark):
    from logscope.plans.pipeline import LineConfig, explain_lines
    rows = [(i, f"m{i}" if i % 3 else "connection timeout", 0.9 if i % 4 == 0 else 0.1, "APP") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "LineId long, message string, anomaly_score double, component string")
    out = {r["LineId"]: r for r in explain_lines(df, LineConfig(strategy="lexical", on_error="rules"),
                                                   client=make_label_client).collect()}
    assert out[4]["anomaly_label_final"] == "memory" and out[12]["anomaly_label_final"] == "network"
    assert out[4]["anomaly_explanation"] == "The cause is likely the component shown."
    assert out[12]["anomaly_explanation"] is not None and not out[12]["anomaly_explanation"].startswith("Error")
    assert out[1]["anomaly_label_final"] is None


def test_running_spreads_a_hot_file(spark):
    from logscope.operators.position import running
    from pyspark.sql import Window
    rows = [("hot", i, i if i % 7 == 0 else None) for i in range(1, 3001)] + \
           [(f"f{j}", i, i if i % 2 else None) for j in range(5) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "f string, n long, v long").repartition(6)
    got = running(df, "f", ["n"], {"ff": ("last", "v"), "cs": ("sum", F.lit(1))}, num_partitions=9)
    w = Window.partitionBy("f").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("rf", F.last("v", ignorenulls=True).over(w)).withColumn("rc", F.count(F.lit(1)).over(w))
    bad = got.join(ref, ["f", "n"]).where(~F.col("ff").eqNullSafe(F.col("rf")) | (F.col("cs") != F.col("rc")))
    assert bad.count() == 0
