"""Writers (SNK1-SNK4). Output is written by many tasks in parallel; order is
carried by range partitioning, never by funnelling rows through one task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column order of the presentation CSV.
PRESENT_COLUMNS = ["LineId", "timestamp", "node", "level", "component", "message", "anomaly_score"]


def present(df: DataFrame) -> DataFrame:
    """Presentation columns in fixed order (only those present), then the final label
    (else the raw label) and the explanation (else the raw explanation); score rounded
    half-even to 3 digits like pandas."""
    cols = [c for c in PRESENT_COLUMNS if c in df.columns]
    for final, raw in (("anomaly_label_final", "anomaly_result"), ("anomaly_explanation", "explanation_result")):
        if final in df.columns:
            cols.append(final)
        elif raw in df.columns:
            cols.append(raw)
    out = df.select(*cols)
    if "anomaly_score" in cols:
        out = out.withColumn("anomaly_score", F.bround("anomaly_score", 3))
    return out


def _csv_field(c: str, dtype: T.DataType):
    if isinstance(dtype, (T.NumericType,)):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    v = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))


def write_results_csv(df: DataFrame, path: str, order_col: str = "LineId", exact: bool = True,
                      mode: str = "overwrite") -> None:
    """Write the presentation table. ``exact``: strings quoted and numbers bare, one
    header line, rows range-partitioned by id so part files concatenate in order.
    Otherwise Spark's CSV writer (every field quoted)."""
    p = present(df)
    if not exact:
        p.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
        return
    line = F.concat_ws(",", *[_csv_field(c, p.schema[c].dataType) for c in p.columns])
    header = ",".join(f'"{c}"' for c in p.columns)
    # the header first, then rows in the id's own type, rows without id last
    kind = p.schema[order_col].dataType
    body = p.select(F.when(F.col(order_col).isNull(), 2).otherwise(1).alias("_h"), F.col(order_col).alias("_k"), line.alias("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("_h"), F.lit(None).cast(kind).alias("_k"), F.lit(header).alias("value"))
    out = head.unionByName(body).repartitionByRange("_h", "_k").sortWithinPartitions("_h", "_k")
    out.select("value").write.mode(mode).text(path)


def write_logs(df: DataFrame, path: str, rows_per_file: int | None = None, order_col: str = "LineId",
               partition_by: str | None = None, mode: str = "overwrite") -> None:
    """Parquet write, range-partitioned on the id; optionally at most ``rows_per_file`` rows
    per file, optionally partitioned by a column (e.g. ``date``) for partition pruning."""
    w = df.repartitionByRange(order_col).sortWithinPartitions(order_col).write.mode(mode)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def nested_counts(counts: DataFrame, date_col: str = "date", text_col: str = "e_message_normalized",
                  count_col: str = "count") -> DataFrame:
    """One row per date with a message -> count map (rows without a message count under the empty text).
    The map is the output's own form: a date's distinct messages are one value."""
    counts = counts.groupBy(date_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).agg(F.sum(count_col).alias(count_col))
    return counts.groupBy(date_col).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col(text_col), F.col(count_col))))).alias("messages"))


def write_nested_counts(counts: DataFrame, path: str, mode: str = "overwrite", **kw) -> None:
    """JSON lines: ``{"date": ..., "messages": {message: count}}``."""
    nested_counts(counts, **kw).withColumn(kw.get("date_col", "date"), F.col(kw.get("date_col", "date")).cast("string")) \
        .write.mode(mode).json(path)


NO_VALUE = "none"


def write_ordered_lines(lines: DataFrame, path: str, by: str, order: Sequence[str], text_col: str = "value",
                        mode: str = "overwrite") -> None:
    """One folder ``by=value`` for each value of ``by``, holding its lines in ``order``.

    Rows are range-partitioned on (by, order) and each task streams its sorted rows to files, so a value with a third
    of all rows is spread over many files and none is gathered in memory. Part files of a folder
    concatenate in order of their names. Null lines are empty; rows without ``by`` go to ``none``.
    Meant for dates, runs or files: Spark makes a folder for each value.
    """
    # not nullable: Spark would otherwise rewrite the column and sort again by it alone
    keyed = lines.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(NO_VALUE))).withColumn(
        "value", F.coalesce(F.col(text_col), F.lit("")))
    (keyed.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
     .select(by, "value").write.mode(mode).partitionBy(by).text(path))


def nested_document_lines(counts: DataFrame, date_col: str = "date", text_col: str = "e_message_normalized",
                          count_col: str = "count") -> DataFrame:
    """Lines of one JSON object ``{message: count}`` a date: ``(date, kind, message, value)``, kind 0 for the opening line, 1 for
    an entry, 2 for the closing line; ordered by (date, kind, message). Rows without a message count under the empty text."""
    c = counts.groupBy(F.coalesce(F.col(date_col).cast("string"), F.lit(NO_VALUE)).alias(date_col),
                       F.coalesce(F.col(text_col), F.lit("")).alias("message")).agg(F.sum(count_col).alias("_n"))
    # one small row a date says which entry takes no comma; the keys of this join are unique on both sides
    dates = c.groupBy(date_col).agg(F.min("message").alias("message"))
    frame = dates.select(date_col, F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit("{").alias("value")), F.struct(F.lit(2).alias("kind"), F.lit("}").alias("value")))).alias("f"))
    frame = frame.select(date_col, "f.kind", F.lit("").alias("message"), "f.value")
    # to_json gives {"m":...}: what stands between the colon and the brace is the escaped text
    entry = c.withColumn("_j", F.to_json(F.struct(F.col("message").alias("m")))).withColumn(
        "_e", F.concat(F.expr("substring(_j, 6, length(_j) - 6)"), F.lit(": "), F.col("_n").cast("string")))
    entry = entry.join(dates.withColumn("_first", F.lit(True)), [date_col, "message"], "left").select(
        date_col, F.lit(1).alias("kind"), "message",
        F.concat(F.when(F.col("_first"), F.lit(" ")).otherwise(F.lit(",")), F.col("_e")).alias("value"))
    return frame.unionByName(entry)


def write_nested_document(counts: DataFrame, path: str, date_col: str = "date", mode: str = "overwrite", **kw) -> None:
    """One JSON object ``{message: count}`` a date in a folder ``date=...``; its part files concatenate to the object.
    Unlike ``write_nested_counts`` no date is collected into one value."""
    write_ordered_lines(nested_document_lines(counts, date_col, **kw), path, date_col, ["kind", "message"], mode=mode)


def read_nested_document(spark: SparkSession, path: str, date_col: str = "date", text_col: str = "e_message_normalized",
                         count_col: str = "count") -> DataFrame:
    """The rows of ``write_nested_document``: date, message, count. Every line is read by itself, in parallel."""
    lines = spark.read.schema(f"value string, `{date_col}` string").text(path).where("value not in ('{', '}')")
    body = F.concat(F.lit("{"), F.expr("substring(value, 2)"), F.lit("}"))
    return (lines.withColumn("_m", F.from_json(body, "map<string,bigint>"))
            .select(F.when(F.col(date_col) != NO_VALUE, F.col(date_col)).alias(date_col), F.explode("_m").alias(text_col, count_col)))


def evaluation_summary(per_class: DataFrame | None, overall: DataFrame | None, distribution: DataFrame | None = None,
                       seconds: float | None = None) -> DataFrame:
    """The evaluation as text lines ``(part, name, line)``: one for each overall figure and each class; without truth
    the predicted classes instead."""
    num = lambda c: F.format_number(F.col(c), 4)
    parts = []
    if overall is not None:
        figures = [c for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1") if c in overall.columns]
        lines = [F.struct(F.lit(f"{i}").alias("name"), F.concat(F.lit(f"{c}: "), F.coalesce(num(c), F.lit("n/a"))).alias("line")) for i, c in enumerate(figures)]
        lines.append(F.struct(F.lit("8").alias("name"), F.concat(F.lit("predictions: "), F.coalesce(F.col("predictions").cast("string"), F.lit("0"))).alias("line")))
        if seconds is not None:
            lines.append(F.struct(F.lit("9").alias("name"), F.lit(f"seconds: {seconds:.2f}").alias("line")))
        parts.append(overall.select(F.lit(0).alias("part"), F.explode(F.array(*lines)).alias("x")).select("part", "x.name", "x.line"))
    if per_class is not None:
        parts.append(per_class.select(F.lit(1).alias("part"), F.col("label").alias("name"), F.concat(
            F.col("label"), F.lit(": precision "), num("precision"), F.lit(", recall "), num("recall"), F.lit(", f1 "), num("f1"),
            F.lit(", rows "), F.col("support").cast("string")).alias("line")))
    if distribution is not None:
        parts.append(distribution.select(F.lit(2).alias("part"), F.col("label").alias("name"), F.concat(
            F.col("label"), F.lit(": "), F.col("count").cast("string"), F.lit(" predictions, "), F.format_number(F.col("percent"), 2), F.lit(" %")).alias("line")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def write_evaluation(detailed: DataFrame, per_class: DataFrame | None, overall: DataFrame | None, path: str,
                     mode: str = "overwrite", distribution: DataFrame | None = None, seconds: float | None = None) -> None:
    """Detailed rows, the per-class table, the overall table and a text summary, as directories. Without true labels
    pass the class distribution instead of the two tables."""
    if overall is None and distribution is None:
        raise ValueError("either the overall and per-class tables or the class distribution is needed")
    base = path.rstrip("/")
    for name, df in (("detailed", detailed), ("per_class", per_class), ("overall", overall), ("class_distribution", distribution)):
        if df is not None:
            df.write.mode(mode).option("header", True).csv(f"{base}/{name}")
    lines = evaluation_summary(per_class, overall, distribution, seconds)
    lines.repartitionByRange("part", "name").sortWithinPartitions("part", "name").select("line").write.mode(mode).text(f"{base}/summary")
