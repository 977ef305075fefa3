from pyspark.sql import functions as F

from logscope.functions.labels import parse_label, rule_label
from logscope.functions.render import filename_hint, render_row, snippet
from logscope.operators import context as ctx
from logscope.operators import prompts as prm
from logscope.operators.position import with_position


def test_label_prompts_threshold(spark):
    # three rows, threshold 0.7: two prompts, one null
    df = spark.createDataFrame([(1, 0.1, "Normal"), (2, 0.8, "Error 1"), (3, 0.9, "Error 2")],
                               "LineId long, anomaly_score double, log_message string")
    df = with_position(df.withColumn("anomaly", F.col("anomaly_score") >= 0.8), "LineId")
    edges = ctx.near_context(df, 2)
    out = {r["LineId"]: r["anomaly_label"] for r in prm.label_prompts(df, edges, 0.7).collect()}
    assert out[1] is None and out[2] is not None and out[3] is not None
    assert "LineId: 2; anomaly_score: 0.8; log_message: Error 1; anomaly: True" in out[2]
    assert "LineId: 1; anomaly_score: 0.1; log_message: Normal; anomaly: False" in out[2]


def test_placeholder_in_data_is_not_expanded(spark):
    df = spark.createDataFrame([(1, 0.9, "{context_str} {log_str}")], "LineId long, anomaly_score double, m string")
    df = with_position(df.withColumn("anomaly", F.lit(False)), "LineId")
    p = prm.label_prompts(df, ctx.near_context(df, 2), 0.5).collect()[0]["anomaly_label"]
    assert "m: {context_str} {log_str}" in p and prm.NO_CONTEXT in p


def test_filename_hint(spark):
    names = ["TOKEN_access_token_auth_header_error_401.log.parquet", "TOKEN_correct.log",
             "TOKEN_delete_user_404_no_user.log", "plain.log", "/a/b/x_y_z_w.log"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [r[0] for r in df.select(filename_hint(F.col("f"))).collect()]
    assert got == ["access token auth header", "correct", "delete user 404", "plain", "y"]
    full = [r[0] for r in df.select(filename_hint(F.col("f"), compat=False)).collect()]
    assert full[0] == "access token auth header error 401"


def test_parse_label_modes(spark):
    replies = [" Network ", "a network connection issue", "Authentication", "API Error: 429", "Error: refused",
               "unknown region", "memory", ""]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    compat = [x[0] for x in df.select(parse_label(F.col("r"), mode="compat")).collect()]
    assert compat == ["network", "io", "authentication", "other", "other", "io", "memory", "other"]
    word = [x[0] for x in df.select(parse_label(F.col("r"), mode="word")).collect()]
    assert word == ["network", "network", "authentication", "other", "other", "other", "memory", "other"]


def test_rule_label(spark):
    rows = [("Out of memory", ""), ("db down", "namenode"), ("database slow", "x"), ("login failed", ""),
            ("link lost", ""), ("cannot open file", ""), ("weird", "")]
    df = spark.createDataFrame(rows, "m string, c string")
    got = [r[0] for r in df.select(rule_label(F.col("m"), F.col("c"))).collect()]
    assert got == ["memory", "application", "database", "authentication", "network", "io", "application"]


def test_render_row_python_forms(spark):
    df = spark.sql("SELECT 1 AS a, true AS b, CAST(NULL AS STRING) AS c, 0.25 AS d, "
                   "TIMESTAMP_NTZ'2024-01-01 00:00:07' AS t, TIMESTAMP_NTZ'2024-01-01 00:00:07.1795' AS u")
    row = df.select(render_row(df)).collect()[0][0]
    assert row == "a: 1; b: True; c: None; d: 0.25; t: 2024-01-01 00:00:07; u: 2024-01-01 00:00:07.179500"


def test_snippet(spark):
    df = spark.createDataFrame([("  " + "x" * 200, 0.5), ("short ", None)], "m string, s double")
    got = [r[0] for r in df.select(snippet(F.col("m"), F.col("s"))).collect()]
    assert got[0] == "(Score: 0.5000) Msg: " + "x" * 150 + "..."
    assert got[1] == "(Score: None) Msg: short"


def test_prompt_variants_and_vocabulary(spark):
    df = spark.createDataFrame([(1, "boom")], "id long, p string")
    v = prm.prompt_variants(df, "p", {"zero": "Q: {input}", "few": "{examples}\nQ: {input}"})
    got = {r["strategy"]: r["variant_prompt"] for r in v.collect()}
    assert got == {"zero": "Q: boom", "few": "\nQ: boom"}
    vocab = spark.createDataFrame([("delete user 404 no user",), ("get token 404",)], "label string")
    hints = spark.createDataFrame([("delete user 404",), ("get token",)], "error_type string")
    m = {r["error_type"]: r["matched_label"] for r in prm.match_known_label(hints, vocab).collect()}
    assert m == {"delete user 404": "delete user 404 no user", "get token": "get token 404"}


def test_canonicalise_priority(spark):
    from logscope.operators.prepare import canonicalise
    df = spark.createDataFrame([(1, 0.5, 0.9, "x", "-")], "row_nr long, pred_ano_proba double, my_score double, "
                               "m_message string, label string")
    ours = canonicalise(df, score="my_score")
    assert ours.select("anomaly_score").first()[0] == 0.9 and "pred_ano_proba" in ours.columns
    ref = canonicalise(df, score="my_score", compat=True)
    assert ref.select("anomaly_score").first()[0] == 0.5 and "my_score" in ref.columns
    assert set(ours.columns) >= {"LineId", "message", "true_label"}
