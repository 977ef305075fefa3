"""File mode: every file is its own data set; words and numbers are features; both file types; known labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logscope.operators import detect
from logscope.plans.files import FileConfig, explain_files, score_files


def lines(spark, name, n, odd=""):
    rows = [(name, i, f"{i % 24:02d}:{i % 60:02d}:00.{i % 1000:03d} [w-{i % 3}]  r{i} DEBUG a.B <init> - path = /x/{i % 4} {odd if i % 7 == 0 else ''}") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "source_file string, line_no long, value string")


@pytest.mark.parametrize("detector", ["LOF", "IF"])
def test_another_file_changes_nothing(spark, detector):
    cfg = FileConfig(detector=detector, trees=10)
    a, b, c = lines(spark, "a.log", 120), lines(spark, "b.log", 90, "alpha"), lines(spark, "b.log", 150, "other words here")
    one, two = (score_files(a.union(x), cfg).where("source_file = 'a.log'") for x in (b, c))
    get = lambda df: {r["line_no"]: r["pred_ano_proba"] for r in df.collect()}
    one, two = get(one), get(two)
    assert one == two and 0 < len(one) < 120 and all(v is not None for v in one.values())


def test_lof_with_words_ties_and_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i + 1000 * (g == "q"), [f"w{x}" for x in rng.integers(0, 3, 3)], float(rng.integers(0, 2))) for g in "pq" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, LineId long, words array<string>, x double")
    train, test = df.where("LineId % 3 <> 0"), df.where("LineId % 3 = 0")
    got = {r["LineId"]: r["pred_ano_proba"] for r in detect.lof(train, test, ["x"], 5, by="g", words_col="words").collect()}
    vec = lambda r: np.array([r[3]] + [r[2].count(f"w{k}") for k in range(3)], float)
    dist = lambda a, b: round(float(np.linalg.norm(vec(a) - vec(b))), 12)
    for g in "pq":
        tr = [r for r in rows if r[0] == g and r[1] % 3]
        near = lambda r, own: sorted((dist(r, o), o[1]) for o in tr if not own or o[1] != r[1])[:5]  # noqa: E731, B023
        nn = {o[1]: near(o, True) for o in tr}
        kd = {i: n[-1][0] for i, n in nn.items()}
        lrd = {i: 1 / (np.mean([max(d, kd[j]) for d, j in n]) + 1e-10) for i, n in nn.items()}
        for r in rows:
            if r[0] == g and r[1] % 3 == 0:
                n = near(r, False)
                want = np.mean([lrd[j] for _, j in n]) * (np.mean([max(d, kd[j]) for d, j in n]) + 1e-10)
                assert abs(got[r[1]] - want) <= 1e-6 * max(1, abs(want))


def test_knn_emits_k_rows_a_query(spark):
    df = spark.createDataFrame([("", i, [1.0], []) for i in range(500)], "_f string, _id long, _x array<double>, _w array<long>")
    got = detect.knn(df, df, 3, exclude_self=True, tile=64).groupBy("_q").agg(F.count("*").alias("n"), F.min("_o").alias("o")).collect()
    assert len(got) == 500 and all(r["n"] == 3 and r["o"] == int(r["_q"] == 0) for r in got)


def test_file_types_and_known_labels(spark):
    bgl = [("x_get_user_404.log", i, f"- 111{i} 2005.06.03 n{i % 3} t n RAS KERNEL INFO core {i % 5} done") for i in range(1, 80)] + [("x_get_user_404.log", 80, "short")]
    df = spark.createDataFrame(bgl, "source_file string, line_no long, value string")
    known = spark.createDataFrame([("get user 404 no user",), ("delete token 404",)], "label string")
    out = explain_files(df, FileConfig(filetype="BGL", known_labels=known)).collect()
    assert len(out) == 1 and "- delete token 404" in out[0]["file_prompt"] and "name: get user 404 no user" in out[0]["file_prompt"]
    with pytest.raises(ValueError, match="file type"):
        explain_files(df, FileConfig(filetype="CSV"))


def test_file_over_the_budget_keeps_its_prompt(spark):
    """A file whose best line alone is over the token budget gets a prompt without lines; others keep theirs."""
    long = "word " * 300
    rows = [("big.log", i, f"{i % 24:02d}:00:00.000 {long}{i}") for i in range(40)]
    rows += [("small.log", i, f"{i % 24:02d}:00:00.000 ok {i}") for i in range(40)]
    raw = spark.createDataFrame(rows, "source_file string, line_no long, value string")
    from logscope.operators.prompts import file_prompts
    lines = spark.createDataFrame([("small.log", 1, "kept line", 0.9), (None, 2, "no file", 0.5)], "source_file string, line_no long, m_message string, pred_ano_proba double")
    names = spark.createDataFrame([("big.log",), ("small.log",), ("small.log",), (None,)], "source_file string")
    got = {r["source_file"]: r["file_prompt"] for r in file_prompts(lines, files=names).collect()}
    assert set(got) == {"big.log", "small.log", None} and "kept line" in got["small.log"]
    prompts = explain_files(raw, FileConfig(detector="IF", token_limit=120)).collect()
    by_file = {r["source_file"]: r["file_prompt"] for r in prompts}
    assert set(by_file) == {"big.log", "small.log"} and "word word" not in by_file["big.log"] and "ok" in by_file["small.log"]
