"""Dense positions (CTX1) without a single-partition window.

Spark rows have no order, so every positional operator needs an explicit
``pos``. A global ``row_number()`` without ``partitionBy`` moves all rows to
one task; instead the rows are range-partitioned on the order key, numbered
inside each partition, and shifted by the counts of the preceding partitions.
The per-partition summary has one row per (partition, group) and is the only
thing broadcast, after its size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.session import materialise

# A summary larger than this is joined with a shuffle instead of a broadcast.
BROADCAST_ROWS = 200_000

# Target input bytes per range partition.
PARTITION_BYTES = 64 << 20


def range_partitions(df: DataFrame, explicit: int | None = None) -> int:
    """Number of range partitions: explicit, else the bytes of all inputs at about ``PARTITION_BYTES``
    per partition, and at least the smaller of the default parallelism and
    ``spark.sql.shuffle.partitions`` (adaptive execution does not coalesce an explicit range
    partitioning, so tiny inputs must not get hundreds of empty partitions). Inputs are summed
    because the optimizer's estimate of a join is the product of its sides."""
    if explicit:
        return explicit
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    floor = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return int(min(max(1, floor, -(-size // PARTITION_BYTES)), (1 << 31) - 1))


def with_position(df: DataFrame, order_by: str | list[str] = "LineId", by: str | list[str] | None = None,
                  out: str = "pos", num_partitions: int | None = None, checkpoint: bool = True,
                  unique: bool = False) -> DataFrame:
    """Add a dense 0-based position after sorting by ``order_by`` (within ``by`` groups if given).

    Works for any group size: a group (file) holding a third of all rows is
    split over many range partitions like any other rows. With ``unique`` (the
    keys identify a row and are not null: a precondition, as line ids are),
    positions are computed and materialised on the key columns only and joined
    back, so the lineage cut writes a narrow table instead of a copy of every column.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    keys = by + order_by
    if unique:
        narrow = with_position(df.select(*keys), order_by, by or None, out, num_partitions, checkpoint)
        return df.join(narrow, keys, "inner")
    n = range_partitions(df, num_partitions)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    if checkpoint:
        # partition ids and generated ids must be evaluated exactly once
        ranged = materialise(ranged)
    stats = ranged.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_offset", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # without groups the summary has at most one row per range partition: a known bound
    if (not by and n <= BROADCAST_ROWS) or stats.count() <= BROADCAST_ROWS:
        stats = F.broadcast(stats)
    joined = ranged.join(stats, ["_pid", *by], "inner")
    return (joined.withColumn(out, F.col("_offset") + F.col("_local") - F.col("_first"))
            .drop("_pid", "_local", "_first", "_offset"))


def running(df: DataFrame, by: str | list[str] | None, order_by: list, aggs: dict,
            num_partitions: int | None = None) -> DataFrame:
    """Running aggregates within ``by`` groups in ``order_by`` order, without putting
    a group into one task.

    ``aggs`` maps an output name to ``("sum", col)`` (inclusive running sum) or
    ``("last", col)`` (last non-null value so far: a forward fill). Rows are
    range-partitioned on (group, order), aggregated locally per partition, and
    each partition adds the carry of the partitions before it; the carry table
    has one row per (partition, group). The partitioned rows are checkpointed once.
    """
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    n = range_partitions(df, num_partitions)
    r = df.repartitionByRange(n, *[F.col(b) for b in by], *order_cols).withColumn("_pid", F.spark_partition_id())
    w_local = Window.partitionBy("_pid", *by).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local, summary = {}, []
    okey = F.struct(*order_cols)
    for name, (kind, col) in aggs.items():
        c = F.col(col) if isinstance(col, str) else col
        if kind == "sum":
            local[f"_l_{name}"] = F.sum(c).over(w_local)
            summary.append(F.sum(c).alias(f"_s_{name}"))
        elif kind == "last":
            local[f"_l_{name}"] = F.last(c, ignorenulls=True).over(w_local)
            summary.append(F.max_by(c, F.when(c.isNotNull(), okey)).alias(f"_s_{name}"))
        else:
            raise ValueError(kind)
    # partition ids must come from one evaluation: the summary and the rows are
    # read from the same materialised copy (two evaluations may coalesce differently)
    r = materialise(r.withColumns(local))
    s = r.groupBy("_pid", *by).agg(*summary)
    w_prev = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = {}
    for name, (kind, _) in aggs.items():
        if kind == "sum":
            carry[f"_c_{name}"] = F.coalesce(F.sum(f"_s_{name}").over(w_prev), F.lit(0))
        else:
            carry[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(w_prev)
    s = s.withColumns(carry).select("_pid", *by, *carry.keys())
    if (not by and n <= BROADCAST_ROWS) or s.count() <= BROADCAST_ROWS:
        s = F.broadcast(s)
    out = r.join(s, ["_pid", *by], "inner")
    final = {}
    for name, (kind, _) in aggs.items():
        if kind == "sum":
            final[name] = F.col(f"_l_{name}") + F.col(f"_c_{name}")
        else:
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_c_{name}"))
    out = out.withColumns(final)
    return out.drop("_pid", *local.keys(), *carry.keys())
