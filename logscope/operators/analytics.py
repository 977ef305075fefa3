"""Summaries over scored lines (ANA1-ANA6). All are partial-then-final aggregates."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Score thresholds of the distribution report.
THRESHOLDS = [0.1, 0.5, 0.7, 0.75, 0.79, 0.8, 0.85, 0.9, 0.95, 1.0]


def score_distribution(df: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                       score_col: str = "anomaly_score") -> DataFrame:
    """Rows and percent with ``score >= t`` for each threshold, in one scan."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(F.col(score_col) >= F.lit(t)).alias(f"_c{i}") for i, t in enumerate(thresholds)]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_c{i}").alias("n"))
                     for i, t in enumerate(thresholds)])
    out = one.select("_total", F.inline(rows))
    return out.select("threshold", F.col("n").cast("long").alias("rows"),
                      F.round(F.col("n") * 100.0 / F.col("_total"), 6).alias("percent"))


def run_summary(df: DataFrame, threshold: float = 0.79, score_col: str = "anomaly_score") -> DataFrame:
    """Total rows and rows with ``score >= threshold``."""
    return df.agg(F.count(F.lit(1)).alias("total_logs"),
                  F.count_if(F.col(score_col) >= F.lit(threshold)).alias("anomalies"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per value, largest first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col(col))


def anomalies_per_date(df: DataFrame, date_col: str = "date", flag_col: str = "anomaly") -> DataFrame:
    """Anomalous lines per date, in date order."""
    return (df.where(F.col(flag_col) == F.lit(True)).groupBy(date_col)
            .agg(F.count(F.lit(1)).alias("anomalies")).orderBy(date_col))


def distinct_messages_per_date(df: DataFrame, date_col: str = "date", text_col: str = "e_message_normalized",
                               flag_col: str = "anomaly", approx: bool = False) -> DataFrame:
    """Distinct anomalous messages per date (exact, or HyperLogLog++ with ``approx``)."""
    d = F.approx_count_distinct(text_col) if approx else F.count_distinct(text_col)
    return (df.where(F.col(flag_col) == F.lit(True)).groupBy(date_col)
            .agg(d.alias("distinct_messages")).orderBy(date_col))


def message_counts(df: DataFrame, date=None, date_col: str = "date", text_col: str = "e_message_normalized",
                   flag_col: str | None = "anomaly") -> DataFrame:
    """Count per (date, message); with ``date``, per message on that date."""
    x = df if flag_col is None else df.where(F.col(flag_col) == F.lit(True))
    if date is not None:
        x = x.where(F.col(date_col) == F.lit(date).cast("date"))
        return x.groupBy(text_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), text_col)
    return x.groupBy(date_col, text_col).agg(F.count(F.lit(1)).alias("count"))
