"""Projection, filter and cleaning operators (row-local unless stated).

Row-local operators use only column expressions, so they also accept a
streaming DataFrame.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default column renames applied by canonicalise (source -> target).
DEFAULT_RENAMES = {
    "pred_ano_proba": "anomaly_score",
    "row_nr": "LineId",
    "m_message": "message",
    "label": "true_label",
}


def canonicalise(df: DataFrame, score: str | None = None, id: str | None = None,
                 message: str | None = None, compat: bool = False,
                 renames: Mapping[str, str] | None = None) -> DataFrame:
    """Rename to the canonical names; a rename applies only when the source
    exists and the target does not. User overrides are tried first unless
    ``compat`` (then the defaults win, as in the original tool)."""
    user = {}
    for src, dst in ((score, "anomaly_score"), (id, "LineId"), (message, "message")):
        if src and src != dst:
            user[src] = dst
    base = dict(renames if renames is not None else DEFAULT_RENAMES)
    if compat:
        order = list(base.items()) + [(s, d) for s, d in user.items() if s not in base]
        order = [(s, user.get(s, d) if s in user else d) for s, d in order]
    else:
        order = list(user.items()) + [(s, d) for s, d in base.items() if s not in user]
    cols = list(df.columns)
    resolved: dict[str, str] = {}
    for src, dst in order:
        if src in cols and dst not in cols:
            cols[cols.index(src)] = dst
            resolved[src] = dst
    return df.withColumnsRenamed(resolved) if resolved else df


def dash_to_normal(df: DataFrame, cols: Iterable[str] = ("label", "true_label")) -> DataFrame:
    """'-' means a normal line in label columns."""
    present = {c: F.when(F.col(c) == "-", F.lit("normal")).otherwise(F.col(c))
               for c in cols if c in df.columns}
    return df.withColumns(present) if present else df


def ensure_score(df: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    """Default score when absent: 1.0 for anomaly = true, else (null included) 0.0."""
    if score_col in df.columns:
        return df
    if "anomaly" in df.columns:
        return df.withColumn(score_col, F.when(F.col("anomaly") == F.lit(True), 1.0).otherwise(0.0))
    return df.withColumn(score_col, F.lit(0.0))


def coerce_score(df: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    """Scores given as text or booleans: 'true' -> 1.0, 'false' -> 0.0, others cast."""
    dtype = df.schema[score_col].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.IntegralType, T.DecimalType)):
        return df.withColumn(score_col, F.col(score_col).cast("double"))
    s = F.lower(F.trim(F.col(score_col).cast("string")))
    return df.withColumn(
        score_col,
        F.when(s == "true", 1.0).when(s == "false", 0.0).otherwise(F.expr(f"try_cast(`{score_col}` AS DOUBLE)")),
    )


def ensure_columns(df: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Add missing columns. A spec value is a Column, a DDL type name (typed null) or a literal."""
    add = {}
    for name, value in spec.items():
        if name in df.columns:
            continue
        if isinstance(value, Column):
            add[name] = value
        elif isinstance(value, str):
            add[name] = F.lit(None).cast(value)
        else:
            add[name] = F.lit(value)
    return df.withColumns(add) if add else df


def fill_text(df: DataFrame) -> DataFrame:
    """Null -> '' in string columns only."""
    return df.na.fill("")


def apply_known_anomalies(df: DataFrame, known: DataFrame, id_col: str = "LineId",
                          score: float = 1.0, score_col: str = "anomaly_score") -> DataFrame:
    """Lines on a known-anomaly list get ``score`` (or the list's own score).

    The list is made unique first so the left join cannot fan out; the join
    strategy (broadcast or shuffle) is left to AQE, which sees the real size.
    """
    k = known.select(F.col(id_col).alias("_kid"),
                     (F.col(score_col) if score_col in known.columns else F.lit(score)).cast("double").alias("_kscore"))
    k = k.groupBy("_kid").agg(F.max("_kscore").alias("_kscore"))
    out = df.join(k, df[id_col] == k["_kid"], "left")
    return out.withColumn(score_col, F.coalesce(F.col("_kscore"), F.col(score_col))).drop("_kid", "_kscore")


def flag_anomalies(df: DataFrame, threshold: float = 0.8, score_col: str = "anomaly_score",
                   flag_col: str = "anomaly") -> DataFrame:
    """An existing flag column wins; otherwise score >= threshold."""
    if flag_col in df.columns:
        return df
    return df.withColumn(flag_col, F.col(score_col) >= F.lit(threshold))


def select_anomalies(df: DataFrame, threshold: float = 0.79, score_col: str = "anomaly_score") -> DataFrame:
    """score >= threshold (a null score is not selected); pushed to the scan."""
    return df.where(F.col(score_col) >= F.lit(threshold))


def select_by_rule(df: DataFrame, keyword: str = "exception", level: str = "WARN", n: int | None = None,
                   text_col: str = "Content", level_col: str = "Level", order_col: str = "LineId") -> DataFrame:
    """Content contains ``keyword`` (any case) or the level equals ``level``; first ``n`` in order."""
    out = df.where(F.lower(F.col(text_col)).contains(keyword.lower()) | (F.col(level_col) == level))
    if n is not None:
        out = out.orderBy(order_col).limit(n)
    return out


def parse_date(c: Column) -> Column:
    """Lenient date: ``yyyy-MM-dd`` or ``yyyy.MM.dd``; otherwise null."""
    s = c.cast("string")
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"),
                      F.try_to_timestamp(s, F.lit("yyyy.MM.dd")).cast("date"))


def date_range(df: DataFrame, lo: str, hi: str, col: str = "date") -> DataFrame:
    """Inclusive date range; string dates are parsed leniently."""
    d = F.col(col) if isinstance(df.schema[col].dataType, T.DateType) else parse_date(F.col(col))
    return df.withColumn(col, d).where(d.between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))))


def limit_date(df: DataFrame, line_id=None, id_col: str = "LineId", date_col: str = "date") -> DataFrame:
    """Keep one date: the latest, or the date of a chosen line.

    The chosen date is a one-row aggregate, so the broadcast side is bounded.
    """
    if line_id is None:
        one = df.agg(F.max(date_col).alias("_d"))
    else:
        one = df.where(F.col(id_col) == F.lit(line_id)).agg(F.max(date_col).alias("_d"))
    return df.join(F.broadcast(one), F.col(date_col) == F.col("_d"), "inner").drop("_d")


def dedup_context(df: DataFrame, col: str, keep_ids: Iterable = (), order_col: str = "pos",
                  id_col: str = "LineId") -> DataFrame:
    """Keep the first row (by ``order_col``) of each distinct ``col`` value, and always the chosen lines.

    First positions come from a partial aggregate (map-side combine), and the
    join back is on (value, position): a hot value does not gather in one task.
    """
    firsts = df.groupBy(col).agg(F.min(order_col).alias(order_col)).withColumn("_first", F.lit(True))
    # null-safe on the value: rows without a value are one group, whose first row stays
    firsts = firsts.select(F.col(col).alias("_dv"), F.col(order_col).alias("_dp"), "_first")
    out = df.join(firsts, df[col].eqNullSafe(F.col("_dv")) & df[order_col].eqNullSafe(F.col("_dp")), "left")
    keep = F.col("_first").isNotNull()
    keep_ids = list(keep_ids)
    if keep_ids:
        keep = keep | F.col(id_col).isin(keep_ids)
    return out.where(keep).drop("_first").select(*df.columns)


def infer_level(message: Column) -> Column:
    """Severity from message text: INFO:, then WARN/WARNING, ERROR, FATAL; default INFO."""
    return (F.when(message.contains("INFO:"), "INFO")
            .when(message.contains("WARN"), "WARNING")
            .when(message.contains("ERROR"), "ERROR")
            .when(message.contains("FATAL"), "FATAL")
            .otherwise("INFO"))


RESULT_COLUMNS = ("anomaly_label", "anomaly_result", "explanation_prompt", "explanation_result")


def finalise(df: DataFrame, clean: bool = False) -> DataFrame:
    """Add ``anomaly_label_final`` and ``anomaly_explanation``; ``clean`` drops prompts
    and raw results where the results exist."""
    cols = df.columns
    add = {}
    if "anomaly_result" in cols:
        add["anomaly_label_final"] = F.col("anomaly_result")
    if "explanation_result" in cols:
        add["anomaly_explanation"] = F.col("explanation_result")
    out = df.withColumns(add) if add else df
    if clean:
        drop = []
        if "anomaly_result" in cols and "anomaly_label" in cols:
            drop += ["anomaly_label", "anomaly_result"]
        if "explanation_result" in cols and "explanation_prompt" in cols:
            drop += ["explanation_prompt", "explanation_result"]
        out = out.drop(*drop)
    return out


def seeded_order(id_cols: Iterable[str], seed: int) -> Column:
    """A reproducible pseudo-random order key (md5 of ids and seed), independent of partitioning."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols], F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, seed: int = 42, id_cols: Iterable[str] = ("LineId",)) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by a seeded hash; a sampling operator, so the limit is the feature."""
    key = seeded_order(id_cols, seed)
    return df.withColumn("_k", key).orderBy("_k", *id_cols).limit(n).drop("_k")


def sample_per_group(df: DataFrame, by: str | list[str], n: int, seed: int = 42,
                     id_cols: Iterable[str] = ("LineId",)) -> DataFrame:
    """``n`` rows per group by seeded hash; ``row_number() <= n`` plans a partial group limit
    before the shuffle, so a hot group is cut down map-side."""
    by = [by] if isinstance(by, str) else list(by)
    id_cols = list(id_cols)
    w = Window.partitionBy(*by).orderBy(seeded_order(id_cols, seed), *id_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def union_files(dfs: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns missing in some inputs become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def working_set(df: DataFrame, cols: Iterable[str], order_col: str = "LineId") -> DataFrame:
    """Reduce to the working columns (pruned at the scan), sorted by id."""
    cols = list(cols)
    return df.select(*cols).orderBy(order_col)
