"""Streaming use of the row-local operators.

The original tool has no streaming; every row-local operator here (renames,
score cleaning, flags, field extraction, normalisation, rule labels and
explanations) is a pure column expression, so it runs unchanged on a
``readStream`` DataFrame. Context selection needs whole-table positions and is
batch-only; ``write_micro_batches`` hands each micro-batch to a batch function.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.labels import rule_explain, rule_label
from logscope.operators import prepare as prp


def label_stream(stream: DataFrame, threshold: float = 0.79, id_col: str = "LineId", seed: int = 0) -> DataFrame:
    """Score-cleaned lines with rule labels and explanations for rows over the threshold."""
    df = prp.dash_to_normal(prp.canonicalise(stream))
    df = prp.coerce_score(prp.ensure_score(df))
    asked = F.col("anomaly_score") >= F.lit(threshold)
    comp = F.col("component") if "component" in df.columns else None
    node = F.col("node") if "node" in df.columns else None
    label = rule_label(F.col("message"), comp)
    return (df.withColumn("anomaly_label_final", F.when(asked, label))
            .withColumn("anomaly_explanation", F.when(asked, rule_explain(label, F.col(id_col), node, comp, seed))))


def write_micro_batches(stream: DataFrame, batch_fn: Callable[[DataFrame, int], None], checkpoint: str,
                        trigger_once: bool = True):
    """Run ``batch_fn(batch_df, epoch_id)`` per micro-batch with a durable checkpoint
    location (exactly-once bookkeeping of the source offsets)."""
    w = stream.writeStream.foreachBatch(batch_fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
