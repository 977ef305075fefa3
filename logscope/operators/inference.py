"""Model calls and response handling (INF1, INF2, INF5-INF7).

The model client is supplied by the caller: a zero-argument factory returning an
object with ``complete(prompt: str, max_tokens: int) -> str``. It is built once
per task on the executors. Failures become values (``Error: ...``), never job
failures. Calls have side effects (cost), so responses are materialised once in
the checkpoint directory and read back: a retried downstream task does not call
the model again. Inside the job that asks, each task appends its replies to a
journal as they arrive, and a retried task asks only for what the journal lacks.
"""

from __future__ import annotations

import re
import time
import uuid
from typing import Callable, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.functions.labels import LABELS, parse_label
from logscope.session import ensure_checkpoint_dir, materialise

ClientFactory = Callable[[], object]

REPLY = T.StructType([T.StructField("_h", T.LongType()), T.StructField("_prompt", T.StringType()),
                      T.StructField("_response", T.StringType())])
_ARROW = pa.schema([("_h", pa.int64()), ("_prompt", pa.string()), ("_response", pa.string())])
# a lost executor pays again for at most this many replies, or for those of this many seconds
FLUSH_CALLS, FLUSH_SECONDS = 256, 5.0


def _open(path: str):
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class _Journal:
    """Replies of one partition of one run: a folder of small Parquet files. A file appears under its
    name only when it is complete."""

    def __init__(self, path: str, part: int, attempt: int, flush_calls: int):
        self.fs, root = _open(path)
        self.folder = f"{root}/part-{part}"
        self.attempt, self.flush_calls = attempt, flush_calls
        self.rows, self.files, self.since = [], 0, time.monotonic()

    def known(self) -> dict:
        """Replies that earlier attempts of this partition paid for."""
        found = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True)):
            if info.is_file and info.base_name.startswith("replies-"):
                t = pq.read_table(info.path, filesystem=self.fs, schema=_ARROW).to_pydict()
                found.update(zip(zip(t["_h"], t["_prompt"]), t["_response"]))
        return found

    def add(self, h: int, prompt: str, reply: str | None) -> None:
        self.rows.append((h, prompt, reply))
        if len(self.rows) >= self.flush_calls or time.monotonic() - self.since >= FLUSH_SECONDS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.fs.create_dir(self.folder, recursive=True)
            name = f"{self.attempt}-{self.files}.parquet"
            cols = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), _ARROW)]
            pq.write_table(pa.Table.from_arrays(cols, schema=_ARROW), f"{self.folder}/_{name}", filesystem=self.fs)
            self.fs.move(f"{self.folder}/_{name}", f"{self.folder}/replies-{name}")
            self.rows, self.files = [], self.files + 1
        self.since = time.monotonic()


def _caller(factory: ClientFactory, max_tokens: int, journal: str | None = None, flush_calls: int = FLUSH_CALLS):
    def ask(client, prompt):
        """The reply, and whether it was one (an error is a value but is asked again on a retry)."""
        if isinstance(client, Exception):
            return f"Error: {client}", False
        try:
            r = client.complete(prompt, max_tokens)
            return (None if r is None else str(r)), True
        except Exception as e:
            return f"Error: {e}", False

    def run(batches):
        client, log, known = None, None, {}
        if journal:
            task = TaskContext.get()
            log = _Journal(journal, task.partitionId() if task else 0, task.taskAttemptId() if task else time.monotonic_ns(), flush_calls)
            known = log.known()
        try:
            for pdf in batches:
                out = []
                for h, p in zip(pdf["_h"].tolist(), pdf["_prompt"]):
                    if (h, p) in known:
                        out.append(known[h, p])
                        continue
                    if client is None:
                        try:
                            client = factory()
                        except Exception as e:  # no client: every prompt gets the error value
                            client = e
                    reply, paid = ask(client, p)
                    out.append(reply)
                    if log and paid:
                        log.add(h, p, reply)
                yield pd.DataFrame({"_h": pdf["_h"], "_prompt": pdf["_prompt"], "_response": out})
        finally:
            if log:
                log.flush()
    return run


def read_journal(spark, journal: str) -> DataFrame | None:
    """Replies in a journal folder, one row a prompt; None where the folder does not exist yet."""
    fs, root = _open(journal)
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return None
    # two attempts of a partition may both have asked: any of the replies will do, but always the same one
    return (spark.read.schema(REPLY).option("recursiveFileLookup", True).parquet(journal)
            .groupBy("_h", "_prompt").agg(F.max("_response").alias("_response")))


def complete(df: DataFrame, prompt_col: str, out_col: str, client: ClientFactory, max_tokens: int = 800,
             parallelism: int | None = None, checkpoint: bool = True, journal: str | None = None,
             flush_calls: int = FLUSH_CALLS) -> DataFrame:
    """Response for each non-null prompt. Identical prompts are sent once; ``parallelism``
    bounds concurrent callers (the number of tasks).

    Replies are journaled, keyed by the prompt's hash and text: a task that is tried again asks only for
    what its earlier attempts had not written (at most ``flush_calls`` replies or five seconds of them are
    paid twice). With ``journal`` (a shared folder that ``pyarrow.fs`` opens) the journal outlives the application: prompts it
    holds leave by an anti-join before any task starts, so a failed or repeated job goes on where it stopped.
    The folder belongs to one client and one ``max_tokens``. Errors are not journaled, an empty reply (None) is.
    Without ``journal`` it lies beside the materialised tables; where ``pyarrow.fs`` cannot open those there is none.
    """
    spark = df.sparkSession
    prompts = (df.where(F.col(prompt_col).isNotNull())
               .select(F.xxhash64(prompt_col).alias("_h"), F.col(prompt_col).alias("_prompt"))
               .dropDuplicates(["_h", "_prompt"]))
    held, folder = None, None
    if journal:
        held = read_journal(spark, journal)
        folder = f"{journal.rstrip('/')}/run-{uuid.uuid4().hex}"
        if held is not None:
            prompts = prompts.join(held, ["_h", "_prompt"], "left_anti")
    elif checkpoint:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logscope-replies-{uuid.uuid4().hex}"
        try:
            _open(folder)
        except (pa.ArrowException, OSError):
            folder = None
    if parallelism:
        prompts = prompts.repartition(parallelism, "_h")
    responses = prompts.mapInPandas(_caller(client, max_tokens, folder, flush_calls), REPLY)
    if checkpoint:
        responses = materialise(responses)
    if held is not None:
        responses = responses.unionByName(held)
    joined = df.join(responses, (F.xxhash64(df[prompt_col]) == responses["_h"]) &
                     (df[prompt_col] == responses["_prompt"]), "left")
    return joined.withColumn(out_col, F.col("_response")).drop("_h", "_prompt", "_response")


def attach(df: DataFrame, responses: DataFrame | None, out_col: str, id_col: str = "LineId",
           value_col: str | None = None) -> DataFrame:
    """Attach responses by id; no responses -> an all-null column. Responses are made
    unique per id first (smallest value wins), so the join cannot duplicate rows."""
    if responses is None:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    value_col = value_col or out_col
    r = responses.groupBy(F.col(id_col).alias("_rid")).agg(F.min(value_col).alias("_val"))
    out = df.join(r, df[id_col] == r["_rid"], "left")
    return out.withColumn(out_col, F.col("_val")).drop("_rid", "_val")


def label_responses(df: DataFrame, client: ClientFactory, prompt_col: str = "anomaly_label",
                    out_col: str = "anomaly_result", labels: Sequence[str] = LABELS, mode: str = "compat",
                    max_tokens: int = 1000) -> DataFrame:
    """Ask the model for a label and map the reply onto the label set."""
    raw = complete(df, prompt_col, "_raw_label", client, max_tokens)
    return raw.withColumn(out_col, parse_label(F.col("_raw_label"), labels, mode)).drop("_raw_label")


def file_responses(df: DataFrame, client: ClientFactory, prompt_col: str = "file_prompt",
                   out_col: str = "file_explanation", max_tokens: int = 1000) -> DataFrame:
    """File-level reply: an empty prompt is an error value, errors pass through, success is trimmed."""
    r = complete(df, prompt_col, "_raw", client, max_tokens)
    raw = F.col("_raw")
    val = (F.when(F.col(prompt_col).isNull() | (F.col(prompt_col) == ""), F.lit("Error: Invalid prompt provided."))
           .when(raw.isNull(), F.lit("Error: LLM call returned no response."))
           .when(raw.startswith("Error:") | raw.startswith("API Error:"), raw)
           .otherwise(F.trim(raw)))
    return r.withColumn(out_col, val).drop("_raw")


def chain(df: DataFrame, steps: Sequence[tuple[Callable[[DataFrame], DataFrame], str]], client: ClientFactory,
          max_tokens: int = 800) -> DataFrame:
    """Multi-step prompting: each step builds a prompt column from the frame (which
    holds the previous responses) and the reply is stored in the named column.
    Each step's replies are materialised before the next step reads them."""
    out = df
    for i, (build, out_col) in enumerate(steps):
        out = build(out)
        out = complete(out, f"_step{i}", out_col, client, max_tokens).drop(f"_step{i}")
    return out
