"""Token budget (TOK1, TOK2)."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscope.functions.text import count_tokens
from logscope.operators.position import running
from logscope.session import materialise


def row_tokens(text: Column, tokenizer: Callable[[str], int] | None = None) -> Column:
    """Tokens of one text: the built-in rule (JVM-side), or a caller's counter in an
    Arrow-batched pandas UDF (e.g. a BPE encoder built once per worker)."""
    if tokenizer is None:
        return count_tokens(text)

    @F.pandas_udf("long")
    def _count(s: pd.Series) -> pd.Series:
        return s.fillna("").map(tokenizer).astype("int64")
    return _count(text)


def token_count(df: DataFrame, text_col: str = "m_message", by: str | list[str] | None = None,
                tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """Tokens of the messages joined by newlines: per-row counts plus one per newline, summed."""
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    x = df.select(*by, row_tokens(F.col(text_col), tokenizer).alias("_t"))
    agg = (F.sum("_t") + F.count(F.lit(1)) - 1).cast("long").alias("tokens")
    return x.groupBy(*by).agg(agg) if by else x.agg(agg)


def trim_to_budget(df: DataFrame, limit: int = 100_000, by: str | list[str] | None = "source_file",
                   score_col: str = "pred_ano_proba", order_col: str = "line_no", text_col: str = "m_message",
                   policy: str = "prefix", tokenizer: Callable[[str], int] | None = None) -> DataFrame:
    """Keep the highest-scored lines whose joined text fits ``limit`` tokens (per group),
    returned with their file order intact.

    ``prefix``: the longest score-ordered prefix that fits. ``iterative``: the
    original loop (drop ``int(n*(1-limit/tokens))`` lowest, 50 if that is 0,
    recount, until no group is over) evaluated on the same cumulative column, one small join per round.
    The cumulative sum is a skew-safe running aggregate, so a file holding a
    third of all lines is still spread over many tasks.
    """
    by_l = [] if by is None else ([by] if isinstance(by, str) else list(by))
    x = df.withColumn("_t", row_tokens(F.col(text_col), tokenizer) + F.lit(1))  # +1: the joining newline
    order = [F.col(score_col).desc_nulls_last(), F.col(order_col).asc()]
    x = running(x, by_l, order, {"_cum": ("sum", "_t"), "_rank": ("sum", F.lit(1))})
    x = x.withColumn("_tok", F.col("_cum") - 1)  # no newline after the last line
    if policy == "prefix":
        return x.where(F.col("_tok") <= limit).drop("_t", "_cum", "_rank", "_tok")
    if policy != "iterative":
        raise ValueError(policy)
    key = by_l if by_l else ["_all"]
    if not by_l:
        x = x.withColumn("_all", F.lit(0))
    x = materialise(x)  # evaluated once, read by every round
    lookup = x.select(*key, "_rank", "_tok")
    state = x.groupBy(*key).agg(F.max("_rank").alias("_n"))
    while True:  # every round drops at least one line of a group that is over, so the loop ends
        cur = state.join(lookup, [*key]).where(F.col("_n") == F.col("_rank")).select(*key, "_n", "_tok")
        drop = F.floor(F.col("_n") * (1 - F.lit(float(limit)) / F.col("_tok"))).cast("long")
        drop = F.when(drop == 0, F.lit(50)).otherwise(drop)
        over = F.col("_tok") > limit
        nxt = cur.select(*key, F.when(over, F.greatest(F.col("_n") - drop, F.lit(0))).otherwise(F.col("_n"))
                         .alias("_n"), over.alias("_more"))
        nxt = materialise(nxt)  # one row per group; cuts the growing lineage of the loop
        state = nxt.select(*key, "_n")
        if nxt.where("_more").limit(1).count() == 0:
            break
    out = x.join(state, key, "inner")
    return out.where(F.col("_rank") <= F.col("_n")).drop("_t", "_cum", "_rank", "_tok", "_n", "_all")
