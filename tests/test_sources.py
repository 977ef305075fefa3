import json

from pyspark.sql import functions as F

from logscope.sources import readers as rd
from logscope.sources import sinks


def test_read_text_lines_uneven_files(spark, tmp_path):
    a = [f"a{i}" for i in range(2500)]
    b = [f"b{i}" for i in range(7)]
    (tmp_path / "a.log").write_text("\n".join(a) + "\n")
    (tmp_path / "b.log").write_text("\n".join(b) + "\n")
    df = rd.read_text_lines(spark, str(tmp_path), maxPartitionBytes=2048)
    rows = df.collect()
    got = {}
    for r in rows:
        got.setdefault(r["source_file"].split("/")[-1], {})[r["line_no"]] = r["value"]
    assert [got["a.log"][i + 1] for i in range(len(a))] == a
    assert [got["b.log"][i + 1] for i in range(len(b))] == b


def test_merge_multiline_and_time(spark):
    lines = ["pre", "12:00:01.500 [t1] r1 INFO c.M <init> - hello", "  at x", "  at y",
             "9:01:02.500 [t2] r2 WARN c.N <init> - bye"]
    df = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(lines)], "source_file string, line_no long, value string")
    out = {r["line_no"]: r["m_message"] for r in rd.merge_multiline(df).collect()}
    assert out == {1: "pre", 2: "\n".join(lines[1:4]), 5: lines[4]}
    from logscope.functions.text import extract_time, strip_time
    t = df.select(extract_time(F.col("value")).alias("t"), strip_time(F.col("value")).alias("m")).collect()
    assert t[0]["t"] is None
    assert t[1]["t"].strftime("%H:%M:%S.%f") == "12:00:01.500000"
    assert t[4]["t"].strftime("%H:%M:%S.%f") == "09:01:02.500000"  # one-digit hour padded first
    assert t[1]["m"].startswith(" [t1]")


def test_label_tree(spark, tmp_path):
    p = tmp_path / "tree.txt"
    p.write_text("### WordCount\nMachine down:\n+ app_1\n+ app_2\nnoise\nDisk full:\n+ app_3\n"
                 "### PageRank\n+ app_4\nNetwork:\n\n+ app_5\n")
    got = sorted((tuple(r) for r in rd.read_label_tree(spark, str(p)).collect()), key=repr)
    assert got == sorted([("PageRank", None, "app_4"), ("PageRank", "Network", "app_5"),
                          ("WordCount", "Disk full", "app_3"), ("WordCount", "Machine down", "app_1"),
                          ("WordCount", "Machine down", "app_2")], key=repr)


def test_read_runs(spark, tmp_path):
    for d, files in {"WordCount_DiskFull_app_1_2": ["c1.log", "c2.log"], "Other_x_y": ["c.log"],
                     "PageRank_Normal_app_9": ["c9.log", "skip.txt"]}.items():
        (tmp_path / d).mkdir()
        for f in files:
            (tmp_path / d / f).write_text(f"content of {f}\nline 2")
    got = sorted((r["Job Type"], r["Issue"], r["run_id"], r["container_id"]) for r in
                 rd.read_runs(spark, str(tmp_path)).collect())
    assert got == [("PageRank", "Normal", "app_9", "c9.log"), ("WordCount", "DiskFull", "app_1_2", "c1.log"),
                   ("WordCount", "DiskFull", "app_1_2", "c2.log")]


def test_read_demos_dedup(spark, tmp_path):
    demos = [{"augmented": True, "text": "t1", "reasoning": "r", "label": "io"},
             {"augmented": True, "text": "t2", "reasoning": "r", "label": "memory"},
             {"augmented": False, "text": "t1", "label": "other"}]
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"predict": {"demos": demos}}))
    got = sorted(tuple(r) for r in rd.read_demos(spark, str(p)).collect())
    assert got == [(0, "t1", "r", "io"), (1, "t2", "r", "memory")]


def test_parse_bgl(spark):
    line = "APPREAD 1117838570 2005.06.03 R02-M1-N0 2005-06-03-15.42.50.363779 R02-M1-N0 RAS KERNEL FATAL data TLB error interrupt"
    df = spark.createDataFrame([(line,), ("- 1 2005.06.03 n t n RAS APP INFO ok",)], "value string")
    r = rd.parse_bgl(df).collect()
    assert r[0]["anomaly"] and r[0]["m_message"] == "data TLB error interrupt" and r[0]["level"] == "FATAL"
    assert not r[1]["anomaly"] and r[1]["timestamp"] == 1


def test_results_csv_exact(spark, tmp_path):
    df = spark.createDataFrame([(2, "n2", 'say "hi"', 0.12345, "io"), (1, "n1", None, 0.5, "memory")],
                               "LineId long, node string, message string, anomaly_score double, anomaly_result string")
    out = tmp_path / "out"
    sinks.write_results_csv(df, str(out))
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert text.splitlines() == ['"LineId","node","message","anomaly_score","anomaly_result"',
                                 '1,"n1","",0.5,"memory"', '2,"n2","say ""hi""",0.123,"io"']


def test_write_logs_chunks(spark, tmp_path):
    df = spark.range(1, 101).withColumnRenamed("id", "LineId")
    sinks.write_logs(df, str(tmp_path / "p"), rows_per_file=30)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 100
    assert len(list((tmp_path / "p").glob("*.parquet"))) >= 4


def test_nested_counts(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-02", "a", 5)],
                               "date string, e_message_normalized string, count long")
    got = {r["date"]: dict(r["messages"]) for r in sinks.nested_counts(df).collect()}
    assert got == {"2024-01-01": {"a": 2, "b": 1}, "2024-01-02": {"a": 5}}


def test_structured_csv_vocabulary_labelled(spark, tmp_path):
    csv_path = tmp_path / "s.csv"
    csv_path.write_text('LineId,Level,Content\n1,WARN,"multi\nline ""quoted"""\n2,INFO,plain\n')
    rows = rd.read_structured_csv(spark, str(csv_path), "LineId long, Level string, Content string").collect()
    assert rows[0]["Content"] == 'multi\nline "quoted"' and rows[1]["LineId"] == 2
    voc = tmp_path / "labels.txt"
    voc.write_text("delete user 404 no user\n\nget token 404\n")
    got = {r["label"]: (r["status_code"], r["tokens"]) for r in rd.read_vocabulary(spark, str(voc)).collect()}
    assert got == {"delete user 404 no user": ("404", ["delete", "user", "404", "no", "user"]),
                   "get token 404": ("404", ["get", "token", "404"])}
    lab = tmp_path / "l.csv"
    lab.write_text("text,labels\nboom,IO\n")
    assert rd.read_labelled(spark, str(lab)).collect()[0]["labels"] == "IO"


def test_write_evaluation(spark, tmp_path):
    from logscope.operators import evaluate as ev
    df = spark.createDataFrame([(1, "io", "io"), (2, "memory", "io")], "LineId long, label string, anomaly_result string")
    sinks.write_evaluation(ev.detailed(df), ev.per_class(df), ev.overall(df), str(tmp_path / "ev"))
    back = spark.read.option("header", True).csv(str(tmp_path / "ev" / "overall")).collect()[0]
    assert back["accuracy"] == "0.5" and back["predictions"] == "2"


def test_release_materialised(spark):
    from logscope.session import materialise, release_materialised
    m = materialise(spark.range(10))
    assert m.count() == 10
    assert release_materialised(spark) >= 1


def test_evaluation_summary_with_and_without_truth(spark, tmp_path):
    from logscope.operators import evaluate as ev
    df = spark.createDataFrame([("io", "io"), ("io", "memory"), ("memory", "memory")], "label string, anomaly_result string")
    base = str(tmp_path / "ev")
    sinks.write_evaluation(ev.detailed(df), ev.per_class(df), ev.overall(df), base, seconds=1.5)
    lines = [r[0] for r in spark.read.text(f"{base}/summary").collect()]
    assert "accuracy: 0.6667" in lines and "seconds: 1.50" in lines and any(x.startswith("io: precision 1.0000, recall 0.5000") for x in lines)
    sinks.write_evaluation(ev.detailed(df), None, None, base + "2", distribution=ev.class_distribution(df))
    assert sorted(r[0] for r in spark.read.text(f"{base}2/summary").collect()) == ["io: 1 predictions, 33.33 %", "memory: 2 predictions, 66.67 %"]
