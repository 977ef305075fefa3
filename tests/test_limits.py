"""No size changes a result: what used to be capped or refused, and rows that used to break or get lost."""

import pytest
from pyspark.sql import functions as F

from logscope.functions.labels import parse_label
from logscope.operators import evaluate as ev
from logscope.operators import prepare as prp
from logscope.operators import prompts as prm
from logscope.operators.budget import token_count, trim_to_budget
from logscope.operators.templates import templates_spell
from logscope.operators.vectors import features
from logscope.plans.pipeline import LineConfig, explain_lines, line_edges
from logscope.session import ensure_checkpoint_dir
from logscope.sources.readers import parse_bgl
from logscope.sources.sinks import nested_counts, write_results_csv


def test_iterative_trim_ends_under_the_limit(spark):
    rows = [("f", 0, "w " * 9_000, 1.0)] + [("f", i, "ab", 0.5 - i / 10_000) for i in range(1, 3000)]
    df = spark.createDataFrame(rows, "source_file string, line_no long, m_message string, pred_ano_proba double")
    kept = trim_to_budget(df, 10_000, "source_file", policy="iterative")
    assert 0 < token_count(kept, by="source_file").first()["tokens"] <= 10_000


def test_vocabulary_has_no_bound(spark):
    df = spark.createDataFrame([([f"w{i}" for i in range(17_000)], 1.0)], "e_words array<string>, e_words_len double")
    out = features(df, [df], numeric_cols=("e_words_len",))[0]
    assert out.first()["features"].size == 17_001


def test_all_demos_are_in_the_prompt(spark):
    demos = spark.createDataFrame([(i, f"t{i}", f"l{i}") for i in range(40)], "demo_no int, text string, label string")
    df = spark.createDataFrame([(1, "x")], "id int, p string")
    out = prm.prompt_variants(df, "p", {"a": "{examples}|{input}"}, demos).first()["variant_prompt"]
    assert out.count("Text: t") == 40 and out.endswith("|x")


def test_known_labels_of_any_number(spark):
    vocab = spark.createDataFrame([(f"label {i} kind{i}",) for i in range(12_000)] + [("disk fault",), ("abcd",)], "label string")
    df = spark.createDataFrame([("Disk-Fault",), ("kind77 x",), ("abce",), (None,)], "error_type string")
    got = {r["error_type"]: r["matched_label"] for r in prm.match_known_label(df, vocab).collect()}
    assert got == {"Disk-Fault": "disk fault", "kind77 x": "label 77 kind77", "abce": "abcd", None: None}


def test_confusion_matrix_is_complete(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "label string, anomaly_result string")
    got = {(r["true_label"], r["pred_label"]): r["count"] for r in ev.confusion_matrix(df).collect()}
    assert len(got) == 9 and got["a", "b"] == 1 and got["b", "c"] == 0


def test_other_masters_need_a_shared_folder(spark):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_short_lines_and_empty_messages(spark):
    df = spark.createDataFrame([(1, "- 111 2005.06.03 n 2005 n RAS KERNEL INFO all good"), (2, "ALERT"), (3, "")], "k int, value string")
    got = {r["k"]: r for r in parse_bgl(df, order_col="k").collect()}
    assert got[1]["m_message"] == "all good" and got[2]["anomaly"] and got[2]["node"] is None and [got[k]["row_nr"] for k in (1, 2, 3)] == [1, 2, 3]
    t = spark.createDataFrame([("",), ("a b",), (None,)], "e_message_normalized string")
    assert templates_spell(t).count() == 3


def test_dedup_keeps_one_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "LineId long, message string")
    assert sorted(r["LineId"] for r in prp.dedup_context(df, "message", order_col="LineId").collect()) == [1, 2]


def test_prepare_eval_ids_labels_and_context(spark):
    df = spark.createDataFrame([("x", "A", "B", "9"), ("y", "C", "D", "8")], "m_message string, label string, labels string, context_ids_ref string")
    rows = ev.prepare_eval(df).orderBy("LineId").collect()
    assert [(r["LineId"], r["label"], r["context_ids_ref"]) for r in rows] == [(0, "a", "9"), (1, "c", "8")]


def test_results_in_id_order_whatever_the_id(spark, tmp_path):
    big = (1 << 53) + 1
    for ids, kind in ((["b", "a", None], "string"), ([big + 1, big, None], "long")):
        df = spark.createDataFrame([(i, "m") for i in ids], f"LineId {kind}, message string")
        path = f"{tmp_path}/{kind}"
        write_results_csv(df, path)
        import glob
        lines = [x for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f).read().splitlines()]
        assert lines[0].startswith('"LineId"') and len(lines) == 4
        first = [x.split(",")[0].strip('"') for x in lines[1:]]
        assert first == [*[str(i) for i in sorted(i for i in ids if i is not None)], ""]


def test_counts_of_missing_messages(spark):
    df = spark.createDataFrame([("d", None, 2), ("d", "x", 1)], "date string, e_message_normalized string, count long")
    assert nested_counts(df).first()["messages"] == {"": 2, "x": 1}


def test_no_reply_is_other(spark):
    df = spark.createDataFrame([(None,), ("IO",), ("a+b",)], "r string")
    got = [r[0] for r in df.select(parse_label(F.col("r"), ["a+b", "io"])).collect()]
    assert got == ["other", "io", "a+b"] or got == ["other", "io", "other"]


def line_rows(n=40):
    return [(i, f"disk {i % 4} failed", "2024-01-0%d" % (1 + i % 2), 0.9 if i % 5 == 0 else 0.1, "n", "c") for i in range(1, n + 1)]


LINES = "LineId long, message string, date string, anomaly_score double, node string, component string"


def test_null_and_repeated_ids_stay(spark):
    df = spark.createDataFrame([(1, "a b", 0.9), (2, "c d", 0.1), (2, "e f", 0.95), (None, "g h", 0.9), (5, "a b", 0.2)], "LineId long, message string, anomaly_score double")
    out = explain_lines(df).collect()
    assert sorted((r["LineId"] or 0) for r in out) == [0, 1, 2, 2, 5]
    with pytest.raises(ValueError, match="null or repeated"):
        explain_lines(df, LineConfig(check_ids=True))


def test_id_lists_are_not_in_prompts(spark):
    out = explain_lines(spark.createDataFrame(line_rows(), LINES))
    assert out.where(F.col("anomaly_label").contains("context_ids")).count() == 0 and out.where("context_ids_ref is not null").count() > 0


def test_pipeline_options(spark):
    df = spark.createDataFrame(line_rows(), LINES)
    with pytest.raises(ValueError, match="unknown strategy"):
        explain_lines(df, LineConfig(strategy="nearest"))
    assert {r["date"] for r in explain_lines(df, LineConfig(limit_date=True)).collect()} == {"2024-01-02"}
    assert {r["date"] for r in explain_lines(df, LineConfig(limit_line=2)).collect()} == {"2024-01-01"}
    out = explain_lines(df, LineConfig(drop_duplicates=True, label_template="L {log_str}"))
    assert out.count() == 4 + 8 and out.where("anomaly_label like 'L %'").count() == 8
    w = explain_lines(df, LineConfig(strategy="window", window=2))
    assert w.count() == 40 and w.where("context_ids_ref is not null").count() > 8
    assert line_edges.__doc__
