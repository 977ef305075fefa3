"""File mode (INF9): many log files at once, every step keyed by ``source_file``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions import text as txt
from logscope.operators.budget import trim_to_budget
from logscope.operators.detect import isolation_forest, lof, split
from logscope.operators.inference import file_responses
from logscope.operators.prompts import file_prompts
from logscope.session import materialise
from logscope.sources.readers import merge_multiline, parse_bgl

LENGTH_FEATURES = ["e_words_len", "e_trigrams_len", "e_chars_len", "e_lines_len", "e_event_id_len"]


@dataclass
class FileConfig:
    detector: str = "LOF"            # "LOF" (the original default) or "IF" (isolation forest)
    filetype: str = "LO2"            # "LO2": stamped lines with continuations; "BGL": one message a line
    token_limit: int = 100_000
    test_frac: float = 0.9
    seed: int = 42
    trees: int = 100
    lof_k: int = 20
    known_labels: DataFrame | None = None  # a vocabulary with a ``label`` column: listed and matched in the prompt


def enhance(lines: DataFrame, text_col: str = "m_message") -> DataFrame:
    """Time, fields, normalised text, words, trigrams and length features of merged lines."""
    x = lines.withColumn("m_timestamp", txt.extract_time(F.col(text_col))) \
        .withColumn(text_col, txt.strip_time(F.col(text_col)))
    x = x.withColumns(txt.extract_fields(F.col(text_col)))
    x = x.withColumn("e_message_normalized", txt.normalise(F.col(text_col)))
    x = x.withColumn("e_words", txt.words(F.col("e_message_normalized")))
    x = x.withColumn("e_trigrams", txt.trigrams(F.col("e_message_normalized")))
    x = x.withColumn("e_event_id", F.md5(F.col("e_message_normalized")).substr(1, 8))
    return x.withColumns(txt.lengths(F.col("e_words"), F.col("e_trigrams"), F.col(text_col), F.col("e_event_id")))


def read_messages(raw: DataFrame, filetype: str) -> DataFrame:
    """Raw lines -> ``(source_file, line_no, m_message, ...)`` by file type."""
    if filetype == "LO2":
        return merge_multiline(raw, txt.TIME_PATTERN, "source_file", "line_no", "value", "m_message")
    if filetype == "BGL":
        return parse_bgl(raw.select("source_file", "line_no", "value"))
    raise ValueError(f"unknown file type {filetype!r}; LO2 or BGL")


def score_files(raw: DataFrame, cfg: FileConfig | None = None, id_col: str = "_line_key") -> DataFrame:
    """The test lines of every file with their scores. Split, fit and neighbours are each file's own, on word
    counts and the five numbers; what another file holds changes nothing."""
    cfg = cfg or FileConfig()
    if cfg.detector not in ("LOF", "IF"):
        raise ValueError(f"unknown detector {cfg.detector!r}; LOF or IF")
    # read by the fit, by the neighbour search and for the scored lines
    lines = materialise(read_messages(raw, cfg.filetype))
    x = enhance(lines).withColumn(id_col, F.xxhash64("source_file", "line_no"))
    train, test = split(x, cfg.test_frac, cfg.seed, [id_col])
    if cfg.detector == "LOF":
        return lof(train, test, LENGTH_FEATURES, cfg.lof_k, id_col, by="source_file", words_col="e_words")
    return isolation_forest(train, test, LENGTH_FEATURES, cfg.trees, 256, cfg.seed, id_col, "source_file", "e_words")


def explain_files(raw: DataFrame, cfg: FileConfig | None = None, client=None, id_col: str = "_line_key") -> DataFrame:
    """Raw lines ``(source_file, line_no, value)`` -> one row per file with its prompt
    (and reply when a client is given): read by file type, enhance, detect, go on with the test
    part, keep the best lines within the token budget, build the file prompt. A file whose best line alone
    is over the budget gets a prompt without lines."""
    cfg = cfg or FileConfig()
    # read for the lines and for the files; words, trigrams and fields of a line are many times its text and stay behind
    scored = materialise(score_files(raw, cfg, id_col).select("source_file", "line_no", "m_message", "pred_ano_proba"))
    kept = trim_to_budget(scored, cfg.token_limit, "source_file", "pred_ano_proba", "line_no", "m_message")
    prompts = file_prompts(kept, "source_file", "m_message", "pred_ano_proba", "line_no", vocabulary=cfg.known_labels, files=scored)
    return file_responses(prompts, client) if client is not None else prompts
