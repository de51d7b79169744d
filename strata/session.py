"""Session helpers: lineage cuts, checkpoint folder, a local session for tests.

The library never invents a storage location on its own: lineage is cut with
``DataFrame.checkpoint()`` into the folder the cluster names in
``spark.checkpoint.dir``.  Only tests, the bench and the smoke entry point call
:func:`ensure_checkpoint_dir`, which sets a folder where none is configured.
"""

from __future__ import annotations

import gc
import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows that one partition of a small materialised frame holds.
GATHERED_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The checkpoint folder of this session, from the context or the conf."""
    path = spark.sparkContext.getCheckpointDir()
    if path:
        return path
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        spark.sparkContext.setCheckpointDir(path)
    return path


def find_package_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, unless a path is set.

    On a cluster the package is installed or sent with ``--py-files``; then this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder; set a scratch one only when unset."""
    find_package_on_workers(spark)
    path = checkpoint_dir(spark)
    if path:
        return path
    path = tempfile.mkdtemp(prefix="strata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once and drop its lineage (reliable checkpoint).

    Iterative operators (connected components, the layer loop) call this once
    per round, so plans stay small and a lost executor only costs the current
    round: the data lives in the shared checkpoint folder, not on executors.
    An eager checkpoint writes while it computes, so the frame is neither computed
    twice nor stored a second time in executor memory.
    """
    if not checkpoint_dir(df.sparkSession):
        raise RuntimeError(
            "strata needs spark.checkpoint.dir (a shared folder) to cut lineage in "
            "iterative jobs; set it on the session"
        )
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the files of shuffles and checkpoints that nothing refers to any more be deleted now.

    Spark deletes them when the driver's heap is collected, which on a driver with little to do may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def gathered(df: DataFrame, rows: int = GATHERED_ROWS) -> DataFrame:
    """A materialised ``df`` of narrow rows in no more partitions than its rows need: the tasks that read a
    small one, and the files that they shuffle, are then few, whatever the session's shuffle partitions."""
    return df.coalesce(max(1, math.ceil(df.count() / rows)))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the cluster only when its scan yields fewer partitions
    than there are cores (a single-row-group file is one task).  On large inputs,
    already split into many partitions, this is a no-op: no shuffle is added."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark
