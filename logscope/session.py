"""Session helpers: a local session for tests and benchmarks, and lineage cuts.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it. A directory is set here only when the
session has none (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def _driver_memory() -> str:
    """About half of physical memory, between 1 and 16 GiB (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, total // (2 << 30)))}g"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "logscope") -> SparkSession:
    """A local session configured the way the tests and the benchmark expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", _driver_memory())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory: the session's own, else ``spark.checkpoint.dir``.

    A folder of this machine is set only for a ``local`` master, where driver and
    executors are one process. On any other master a missing setting is an error:
    executors would write intermediate tables to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="logscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers
    find it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="logscope-pkg-"), "logscope.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "logscope")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows as a table in the shared checkpoint directory
    and reading them back.

    Used where later steps must see one fixed evaluation of a non-deterministic
    expression (positions, paid model responses) or read an intermediate several
    times. The plan is evaluated once, adaptive execution still sizes the output,
    the copy survives executor loss (unlike a local checkpoint), and the read-back
    carries real size statistics for the optimizer.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/logscope-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def release_materialised(spark: SparkSession) -> int:
    """Delete the tables ``materialise`` wrote for this application (call when the
    results built on them are no longer needed). The checkpoint directory Spark
    hands out is per application, so other jobs' files are untouched. Returns the
    number of tables removed."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        return 0
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    removed = 0
    for status in fs.listStatus(path):
        p = status.getPath()
        if p.getName().startswith("logscope-"):
            fs.delete(p, True)
            removed += 1
    return removed
