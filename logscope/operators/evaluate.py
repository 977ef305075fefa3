"""Label evaluation (EVL1-EVL8, PRP16). Every metric is an aggregate over
(true, predicted) pair counts, so the work is one partial aggregate of the rows
plus small tables whose size is the number of classes squared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.operators.position import with_position
from logscope.operators.prepare import coerce_score


def _pairs(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    return (df.where(F.col(pred_col).isNotNull() & F.col(true_col).isNotNull())
            .groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label"))
            .agg(F.count(F.lit(1)).alias("n")))


_SLICES = 16


def confusion_matrix(df: DataFrame, true_col: str = "label", pred_col: str = "anomaly_result") -> DataFrame:
    """Long-form confusion matrix over the sorted union of true and predicted labels, zeros included.

    The result has a row for each pair of classes by definition; the grid is an equality join on
    slice numbers, so it is made by many tasks and nothing passes through the driver."""
    pairs = _pairs(df, true_col, pred_col)
    labels = pairs.select(F.col("true_label").alias("l")).union(pairs.select(F.col("pred_label").alias("l"))).distinct()
    left = labels.select(F.col("l").alias("true_label"), F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))).alias("_s"))
    right = labels.select(F.col("l").alias("pred_label"), F.pmod(F.xxhash64("l"), F.lit(_SLICES)).cast("int").alias("_s"))
    grid = left.join(right, "_s").drop("_s")
    return (grid.join(pairs, ["true_label", "pred_label"], "left")
            .select("true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def _class_stats(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    pairs = _pairs(df, true_col, pred_col)
    tp = pairs.where(F.col("true_label") == F.col("pred_label")).select(F.col("true_label").alias("label"),
                                                                       F.col("n").alias("tp"))
    sup = pairs.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("support"))
    pred = pairs.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("predicted"))
    x = sup.join(pred, "label", "full").join(tp, "label", "left")
    x = x.select("label", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("tp", "support", "predicted")])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    x = x.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall")
                / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return x.withColumn("f1", f1)


def per_class(df: DataFrame, true_col: str = "label", pred_col: str = "anomaly_result") -> DataFrame:
    """Precision, recall, F1 and support per class; zero division gives 0."""
    x = _class_stats(df, true_col, pred_col)
    return x.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    F.round("f1", 6).alias("f1"), F.col("support").cast("long").alias("support"))


def overall(df: DataFrame, true_col: str = "label", pred_col: str = "anomaly_result") -> DataFrame:
    """Accuracy and support-weighted precision/recall/F1 over rows with a prediction
    (weighted recall equals accuracy: a built-in cross-check)."""
    x = _class_stats(df, true_col, pred_col)
    g = x.agg(F.sum("support").alias("total"), F.sum("tp").alias("hit"),
              F.sum(F.col("precision") * F.col("support")).alias("wp"),
              F.sum(F.col("recall") * F.col("support")).alias("wr"),
              F.sum(F.col("f1") * F.col("support")).alias("wf"))
    return g.select(F.round(F.col("hit") / F.col("total"), 6).alias("accuracy"),
                    F.round(F.col("wp") / F.col("total"), 6).alias("weighted_precision"),
                    F.round(F.col("wr") / F.col("total"), 6).alias("weighted_recall"),
                    F.round(F.col("wf") / F.col("total"), 6).alias("weighted_f1"),
                    F.col("total").cast("long").alias("predictions"))


def class_distribution(df: DataFrame, pred_col: str = "anomaly_result") -> DataFrame:
    """Predicted class counts and percent (when no truth exists)."""
    x = df.where(F.col(pred_col).isNotNull()).groupBy(F.col(pred_col).alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over one row per class
    return x.select("label", F.col("count").cast("long"),
                    F.round(F.col("count") * 100.0 / total, 6).alias("percent"))


def detailed(df: DataFrame, id_col: str = "LineId", text_col: str = "text", true_col: str = "label",
             pred_col: str = "anomaly_result") -> DataFrame:
    """Per-row evaluation table with ``correct`` (null when either label is missing)."""
    cols = [c for c in (id_col, text_col) if c in df.columns]
    return df.select(*cols, F.col(true_col).alias("true_label"), F.col(pred_col).alias("predicted_label"),
                     (F.col(true_col) == F.col(pred_col)).alias("correct"))


def compare_models(df: DataFrame, model_col: str = "model", true_col: str = "label", pred_col: str = "pred",
                   cost_col: str = "cost", seconds_col: str = "seconds", error_col: str = "error") -> DataFrame:
    """Per model: exact-match score (percent), total cost and runtime, first error;
    best first, failed models (no prediction) last with null score."""
    hit = (F.lower(F.trim(F.col(true_col))) == F.lower(F.trim(F.col(pred_col)))).cast("int")
    err = F.min(F.col(error_col)) if error_col in df.columns else F.lit(None).cast("string")
    g = df.groupBy(model_col).agg(
        F.round(F.avg(F.when(F.col(pred_col).isNotNull(), hit)) * 100.0, 6).alias("score"),
        F.round(F.sum(cost_col), 6).alias("cost"), F.round(F.sum(seconds_col), 6).alias("runtime"),
        err.alias("error"))
    return g.orderBy(F.col("score").desc_nulls_last(), F.col(model_col))


def success_rate(df: DataFrame, true_col: str = "label", pred_col: str = "pred", by: str | None = None) -> DataFrame:
    """Exact-match success rate in percent, overall or per group."""
    rate = F.round(F.avg((F.col(true_col) == F.col(pred_col)).cast("int")) * 100.0, 6).alias("success_rate")
    n = F.count(F.lit(1)).alias("n")
    return df.groupBy(by).agg(rate, n) if by else df.agg(rate, n)


def judge_summary(df: DataFrame, score_col: str = "score",
                  criteria=("accuracy", "relevance", "completeness", "clarity")) -> DataFrame:
    """Min, max and mean of a 0-10 judge score, plus the mean of each criterion present."""
    aggs = [F.min(score_col).cast("double").alias("min_score"), F.max(score_col).cast("double").alias("max_score"),
            F.round(F.avg(score_col), 6).alias("mean_score"), F.count(score_col).alias("judged")]
    aggs += [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in criteria if c in df.columns]
    return df.agg(*aggs)


def prepare_eval(df: DataFrame, id_col: str = "LineId", order_by: str | list[str] | None = None) -> DataFrame:
    """Evaluation input: ``text`` from ``m_message``; an id (missing: 0..n-1 in the order of ``order_by``, else of all
    columns); score from ``pred_ano_proba`` else 1.0; context = own id unless given; ``label`` from
    ``label``, else ``labels``, else ``anomaly_type``, lower-cased."""
    out = df
    if "text" not in out.columns and "m_message" in out.columns:
        out = out.withColumnRenamed("m_message", "text")
    if id_col not in out.columns:
        out = with_position(out, order_by or out.columns, out=id_col)
    if "anomaly_score" not in out.columns:
        out = out.withColumn("anomaly_score", F.col("pred_ano_proba") if "pred_ano_proba" in out.columns
                             else F.lit(1.0))
        out = coerce_score(out)
    if "context_ids_ref" not in out.columns:
        out = out.withColumn("context_ids_ref", F.col(id_col).cast("string"))
    for source in ("label", "labels", "anomaly_type"):
        if source in out.columns:
            return out.withColumn("label", F.lower(F.col(source)))
    return out
