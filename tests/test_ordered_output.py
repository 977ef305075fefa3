"""Writers that stream a date or a run in order, without gathering it."""

import json
import random

import pytest

from logscope.operators import prompts as prm
from logscope.sources import sinks


@pytest.fixture(autouse=True)
def many_files(spark):
    """The small tables of these tests would be coalesced to one file."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def folder_text(path, name):
    return "".join(p.read_text() for p in sorted((path / name).glob("part-*")))


def awkward(n):
    rnd = random.Random(3)
    marks = ['"', "\\", "\n", "{", "}", ",", "é", "\t", "a", "b", " "]
    return ["".join(rnd.choice(marks) for _ in range(rnd.randrange(0, 9))) + str(i) for i in range(n)]


def test_nested_document_is_json_in_order(spark, tmp_path):
    texts = awkward(3_000)
    rows = [("2024-01-02", t, i + 1) for i, t in enumerate(texts)]           # one date holds nearly everything
    rows += [("2024-01-01", "x", 2), ("2024-01-01", "x", 3), ("2024-01-03", None, 4), ("2024-01-03", "", 1), (None, "y", 7)]
    df = spark.createDataFrame(rows, "date string, e_message_normalized string, count long").repartition(5)
    out = tmp_path / "nested"
    sinks.write_nested_document(df, str(out))
    assert len(list((out / "date=2024-01-02").glob("part-*"))) > 1           # the hot date is spread
    big = folder_text(out, "date=2024-01-02")
    assert json.loads(big) == {t: i + 1 for i, t in enumerate(texts)}
    assert list(json.loads(big)) == sorted(texts, key=lambda t: t.encode())
    assert json.loads(folder_text(out, "date=2024-01-01")) == {"x": 5}
    assert json.loads(folder_text(out, "date=2024-01-03")) == {"": 5}
    assert json.loads(folder_text(out, "date=none")) == {"y": 7}
    want = {(d, t or ""): 0 for d, t, _ in rows}
    for d, t, n in rows:
        want[d, t or ""] += n
    back = sinks.read_nested_document(spark, str(out)).collect()
    assert {(r["date"], r["e_message_normalized"]): r["count"] for r in back} == want and len(back) == len(want)


def test_nested_document_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "date string, e_message_normalized string, count long")
    sinks.write_nested_document(empty, str(tmp_path / "e"))
    assert sinks.read_nested_document(spark, str(tmp_path / "e")).count() == 0


def test_nested_lines_gather_no_group(spark):
    df = spark.createDataFrame([("d", "m", 1)], "date string, e_message_normalized string, count long")
    plan = sinks.nested_document_lines(df)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Window" not in plan


def test_run_prompts_from_files(spark, tmp_path):
    rows = [("a", i, f"line {i}") for i in range(2_000)] + [("b", 2, "two"), ("b", 1, "one"), ("b", 3, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "run_id string, line_no int, Content string").repartition(4)
    want = {r["run_id"]: r["prompt"] for r in prm.run_prompts(df, ["x", "y"], order_col="line_no").collect()}
    out = tmp_path / "runs"
    sinks.write_ordered_lines(prm.run_prompt_lines(df, ["x", "y"]), str(out), "run_id", ["part", "line_no"], "line")
    assert len(list((out / "run_id=a").glob("part-*"))) > 1
    for run in "ab":
        assert folder_text(out, f"run_id={run}") == want[run] + "\n"
    assert folder_text(out, "run_id=c").rstrip("\n") == want["c"].rstrip("\n")
    assert "collect_list" not in prm.run_prompt_lines(df, ["x"])._jdf.queryExecution().toString()


def test_run_prompt_template_with_tail(spark):
    df = spark.createDataFrame([("a", 1, "l1"), ("a", 2, "l2")], "run_id string, line_no int, Content string")
    t = "Of {classes}:\n{content}\nAnswer."
    lines = prm.run_prompt_lines(df, ["x"], template=t).orderBy("run_id", "part", "line_no").collect()
    assert "\n".join(r["line"] for r in lines) == "Of ['x']:\nl1\nl2\nAnswer."
