"""The reply journal: what was paid for is not asked again."""

import os

import pandas as pd
import pytest

from logscope.operators import inference as inf


def counting(calls: str, die_at: int | None = None):
    """A client factory that notes each call in a file; the worker process dies, once, before the given call."""
    def make():
        class Client:
            def complete(self, prompt, max_tokens):
                with open(calls, "a") as f:
                    f.write(prompt + "\n")
                if die_at is not None and not os.path.exists(calls + ".died"):
                    with open(calls) as f:
                        if sum(1 for _ in f) > die_at:
                            open(calls + ".died", "w").close()
                            os._exit(1)
                if prompt.endswith("bad"):
                    raise RuntimeError("refused")
                return None if prompt.endswith("none") else f"reply {prompt}"
        return Client()
    return make


def asked(path):
    with open(path) as f:
        return f.read().split("\n")[:-1]


def prompts(spark, n=60):
    rows = [(i, f"p{i}") for i in range(n)] + [(100, "p0"), (101, None), (102, "is bad"), (103, "has none"), (104, "")]
    return spark.createDataFrame(rows, "id long, prompt string")


def want(n=60):
    return {i: f"reply p{i}" for i in range(n)} | {100: "reply p0", 101: None, 102: "Error: refused", 103: None, 104: "reply "}


def got(df):
    return {r["id"]: r["r"] for r in df.collect()}


def test_job_killed_goes_on_from_the_journal(spark, tmp_path):
    calls, journal = str(tmp_path / "calls"), f"file://{tmp_path}/journal"
    client = counting(calls, die_at=25)
    ask = lambda: inf.complete(prompts(spark), "prompt", "r", client, parallelism=1, journal=journal, flush_calls=1)
    with pytest.raises(Exception):
        ask()
    before = len(asked(calls))
    assert before > 25
    assert got(ask()) == want()
    # 63 distinct prompts, the one in flight when the worker died, and the error if the first job had reached it
    assert 64 <= len(asked(calls)) <= 65
    again = len(asked(calls))
    assert got(ask()) == want()
    assert asked(calls)[again:] == ["is bad"]


def test_retried_task_asks_only_for_the_rest(tmp_path):
    calls, folder = str(tmp_path / "calls"), str(tmp_path / "j")
    batch = pd.DataFrame({"_h": range(10), "_prompt": [f"p{i}" for i in range(9)] + ["has none"]})
    first = inf._caller(counting(calls), 10, folder, flush_calls=4)(iter([batch[:7], batch[7:]]))
    next(first)
    first.close()                                   # the attempt ends after its first batch
    whole = pd.concat(inf._caller(counting(calls), 10, folder)(iter([batch])))
    assert whole["_response"].tolist() == [f"reply p{i}" for i in range(9)] + [None]
    assert asked(calls) == batch["_prompt"].tolist()


def test_a_torn_file_is_not_read(tmp_path):
    calls, folder = str(tmp_path / "calls"), tmp_path / "j"
    (folder / "part-0").mkdir(parents=True)
    (folder / "part-0" / "_1-0.parquet").write_bytes(b"PAR1 torn")
    batch = pd.DataFrame({"_h": [1], "_prompt": ["p"]})
    out = list(inf._caller(counting(calls), 10, str(folder))(iter([batch])))
    assert out[0]["_response"].tolist() == ["reply p"]


def test_equal_hashes_do_not_share_a_reply(tmp_path):
    calls, folder = str(tmp_path / "calls"), str(tmp_path / "j")
    run = lambda p: list(inf._caller(counting(calls), 10, folder)(iter([pd.DataFrame({"_h": [5], "_prompt": [p]})])))[0]["_response"][0]
    assert [run("a"), run("b"), run("a")] == ["reply a", "reply b", "reply a"]
    assert asked(calls) == ["a", "b"]


def test_default_journal_and_empty_input(spark, tmp_path):
    calls = str(tmp_path / "calls")
    assert got(inf.complete(prompts(spark, 5), "prompt", "r", counting(calls))) == want(5)
    assert len(asked(calls)) == 8
    assert inf.complete(prompts(spark).where("false"), "prompt", "r", counting(calls), journal=str(tmp_path / "e")).count() == 0
