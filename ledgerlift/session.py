"""Session helpers shared by tests, bench and the jobs that write tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlift") -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting (tests) gets a temporary folder, which is registered so
    that later calls agree on it; elsewhere a missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ledgerlift-", dir="/tmp"))
    return context.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared folder."""
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark).rstrip('/')}/ledgerlift/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a query has shuffled leaves the disk when it ends; otherwise it stays until the driver's next full garbage collection.

    A DataFrame that is run a second time shuffles again. The setting is one of the session, so its other queries follow it too.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def default_buckets(spark: SparkSession) -> int:
    """How many ranges to cut a table into so that every core has work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work that is long per row.

    A table of one file with one row group is one task. Only an input that comes from
    its files in fewer tasks than there are cores is dealt out anew; a larger one, or
    one that has been shuffled already or is a stream, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
