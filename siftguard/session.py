"""Session helpers: a tuned session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "siftguard") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SIFTGUARD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    What ``--py-files`` does on submission: the driver serves the archive to executors.
    """
    context = spark.sparkContext
    if getattr(context, "_siftguard_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # The driver serves the archive for the life of the application.
    archive = Path(tempfile.mkdtemp(prefix="siftguard-code-")) / "siftguard.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._siftguard_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one machine, may fall
    back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="siftguard-")
    context.setCheckpointDir(base)
    return base


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    context = spark.sparkContext
    root = getattr(context, "_siftguard_scratch", None)
    if root is None:
        root = f"{shared_dir(spark)}/siftguard-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._siftguard_scratch = root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for data between jobs; results read it until the application ends."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage of iterative jobs; the files outlive lost executors and keep
    column pruning and filter pushdown for the next round.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once their last reader has written its result.

    Nothing may be read from them afterwards, not even to rebuild lost parts: what was made
    of them must be written itself.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan of a few splits over all cores; leave a large table as it is.

    For CPU-heavy work on small files, where one task would do everything. A table
    with at least as many splits as cores is read in place, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan.repartition(cores) if splits < cores else scan


def keep_hot(df: DataFrame, rows_per_partition: int = 50_000) -> DataFrame:
    """Cache a table for many passes, in no more partitions than its size asks for.

    Iterative work pays for every task in every pass. The cache may be rebuilt from
    its sources if an executor is lost.
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    wanted = max(1, -(-cached.count() // rows_per_partition))
    return cached.coalesce(wanted) if wanted < cached.rdd.getNumPartitions() else cached


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Partition for Python work per group, in a fixed number of tasks.

    Adaptive execution merges small partitions by their bytes; a group's cost in
    Python is not in its bytes, so the number of tasks is set here.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
