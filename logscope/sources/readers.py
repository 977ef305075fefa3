"""Readers (SRC1-SRC11). Every reader is lazy and partitioned; order inside a
file is an explicit ``line_no`` column because Spark rows carry no order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logscope.functions.text import TIME_PATTERN
from logscope.operators.position import running, with_position


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet scan of one path, several paths or a glob of chunk files."""
    return spark.read.parquet(*paths)


def read_structured_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                        multi_line: bool = True) -> DataFrame:
    """Structured-log CSV with a header. Quoted fields may hold line breaks; where they do not,
    ``multi_line=False`` lets Spark split large files."""
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (r.schema(schema) if schema is not None else r.option("inferSchema", False)).csv(path)


def read_text_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Raw lines with their file and exact 1-based line number inside the file.

    Order inside a file is (split start, generated id): splits of one file may
    land in any partition order, so the generated id alone is not a contract.
    """
    df = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value"))
    df = with_position(df, ["_block", "_mid"], by="source_file", out="line_no")
    return df.select("source_file", (F.col("line_no") + 1).alias("line_no"), "value")


def merge_multiline(df: DataFrame, pattern: str = TIME_PATTERN, file_col: str = "source_file",
                    order_col: str = "line_no", text_col: str = "value", out: str = "m_message") -> DataFrame:
    """A line without the timestamp pattern joins the preceding stamped line.
    Lines before the first stamp of a file form group 0.

    The group id is a skew-safe forward fill (no per-file window); the merge is
    a group-by on (file, group) with an ordered collect of one message's lines.
    """
    x = df.withColumn("_stamp", F.when(F.col(text_col).rlike(pattern), F.col(order_col)))
    x = running(x, file_col, [order_col], {"_gid": ("last", "_stamp")})
    x = x.withColumn("_gid", F.coalesce(F.col("_gid"), F.lit(0)))
    g = x.groupBy(file_col, "_gid").agg(
        F.min(order_col).alias(order_col),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order_col, text_col))),
                                 lambda s: s[text_col]), "\n").alias(out))
    return g.drop("_gid")


def parse_bgl(df: DataFrame, text_col: str = "value", order_col: str | list[str] | None = None) -> DataFrame:
    """Supercomputer (BGL-style) lines: alert tag ('-' = normal), epoch, date, node, time,
    node again, type, component, level, content; ``anomaly = tag != '-'``. Fields that a short line lacks
    are null. ``row_nr`` is the 1-based place in ``order_col`` order, where that column is given."""
    p = F.split(F.col(text_col), " ", 10)
    fields = ["label", "timestamp", "date", "node", "time", "noderepeat", "type", "component", "level", "m_message"]
    out = df.select("*", *[F.get(p, i).alias(n) for i, n in enumerate(fields)])
    out = out.withColumn("timestamp", F.expr("try_cast(timestamp AS BIGINT)")).withColumn(
        "anomaly", F.col("label") != "-")
    if order_col is None:
        return out
    return with_position(out, order_col, out="row_nr").withColumn("row_nr", F.col("row_nr") + 1)


def read_label_tree(spark: SparkSession, path: str) -> DataFrame:
    """Label tree: ``### app`` opens an application, a line ending ``:`` a failure type,
    ``+ id`` a member; other lines are ignored. -> ``(app, failure, app_id)``."""
    lines = read_text_lines(spark, path).withColumn("_t", F.trim("value"))
    return label_tree_rows(lines)


def label_tree_rows(lines: DataFrame, text_col: str = "_t") -> DataFrame:
    t = F.col(text_col)
    is_app = t.startswith("###")
    is_fail = ~is_app & t.endswith(":") & ~t.startswith("+")
    x = lines.withColumns({
        "_app": F.when(is_app, F.trim(F.regexp_replace(t, r"^#+", ""))),
        # a new application resets the failure type: the fill value is a struct
        "_fail": F.when(is_app, F.struct(F.lit(None).cast("string").alias("v")))
        .when(is_fail, F.struct(F.trim(F.regexp_replace(t, r":$", "")).alias("v"))),
    })
    x = running(x, "source_file", ["line_no"], {"_app_f": ("last", "_app"), "_fail_f": ("last", "_fail")})
    m = x.where(t.startswith("+"))
    return m.select(F.col("_app_f").alias("app"), F.col("_fail_f.v").alias("failure"),
                    F.trim(F.regexp_replace(t, r"^\+", "")).alias("app_id"))


def read_runs(spark: SparkSession, root: str, prefixes=("WordCount", "PageRank")) -> DataFrame:
    """One row per container log: ``{job}_{issue}_{run_id...}/{container}.log`` with its whole content."""
    df = (spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.log")
          .select(F.col("_metadata.file_path").alias("_path"), F.col("value").alias("Content")))
    parts = F.split(F.col("_path"), "/")
    run_dir = F.try_element_at(parts, F.lit(-2))
    rp = F.split(run_dir, "_")
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | run_dir.startswith(p)
    return df.where(cond).select(
        F.get(rp, 0).alias("Job Type"), F.get(rp, 1).alias("Issue"),
        F.array_join(F.slice(rp, 3, F.greatest(F.size(rp) - 2, F.lit(0))), "_").alias("run_id"),
        F.element_at(parts, -1).alias("container_id"), "Content")


def vocabulary_rows(label: F.Column) -> dict:
    """Vocabulary columns derived from a label: status code and tokens."""
    return {"status_code": F.regexp_extract(label, r"\b(\d{3})\b", 1),
            "tokens": F.split(F.lower(label), " ")}


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Known-label vocabulary, one label per line -> ``(label, status_code, tokens)``."""
    df = spark.read.text(path).select(F.trim("value").alias("label")).where(F.col("label") != "")
    return df.withColumns(vocabulary_rows(F.col("label")))


def read_labelled(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Labelled evaluation rows (``text, labels`` and optional id/score)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return read_structured_csv(spark, path)


DEMO_ITEM = T.StructType([
    T.StructField("augmented", T.BooleanType()), T.StructField("text", T.StringType()),
    T.StructField("reasoning", T.StringType()), T.StructField("label", T.StringType()),
])


def read_demos(spark: SparkSession, path: str, field: str = "predict.demos") -> DataFrame:
    """Few-shot demos from an optimiser JSON file, first copy of each text kept.
    -> ``(demo_no, text, reasoning, label)``."""
    raw = spark.read.option("multiLine", True).json(path)
    demos = raw.select(F.posexplode(F.col(field)).alias("demo_no", "d"))
    demos = demos.select("demo_no", F.col("d.text").alias("text"),
                         (F.col("d.reasoning") if "reasoning" in str(raw.schema) else F.lit(None).cast("string"))
                         .alias("reasoning"), F.col("d.label").alias("label"))
    firsts = demos.groupBy("text").agg(F.min("demo_no").alias("demo_no"))
    return demos.join(firsts, ["text", "demo_no"], "left_semi").select("demo_no", "text", "reasoning", "label")
