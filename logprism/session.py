"""Session settings, and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the library expects.  AQE sizes the shuffles, turns joins with a
#: side that proves small at run time into broadcasts, and splits skewed
#: partitions; UTC makes clock features independent of the cluster's zone.  The
#: JVM never compiles methods above 8000 bytes of bytecode, so wide projections
#: run faster when Spark splits them than as one generated method.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
}


ARCHIVE = "logprism-package"
#: Applications that have been given the package.
_SHIPPED: set[str] = set()


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("logprism")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        # no call-site lookup for every Column: plans here have hundreds of them
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the library's SQL settings on a session somebody else created, and ship the package."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they run.

    The archive is made next to the driver program; Spark itself copies it to
    every executor, so it need not lie in a shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="run-"), f"{ARCHIVE}-{uuid.uuid4().hex}"), "zip",
        os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach: ``spark.checkpoint.dir``.

    A temporary folder is used only where the setting is absent and the
    master is local; on a cluster the absence is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getCheckpointDir()
    if configured is None:
        if re.fullmatch(r"local(\[.*\])?", context.master) is None:  # local-cluster is a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="logprism-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def run_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under :func:`shared_dir`; Spark creates it on write."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For results that several jobs read: unlike a cache, the table survives the
    loss of executors, keeps its statistics, and can be read by column.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the folders of stored tables that nothing reads any more, and the shuffle files of finished jobs."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark keeps them until the driver forgets the job's plan, so the driver's
    JVM is asked to collect its garbage.  The listeners hold the plan of the
    last job until another has begun, therefore a small one is run before.
    """
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: recomputation can no longer change the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
