"""File listings: catalogues, storage totals, integrity and retention.

Listings use the ``binaryFile`` source; file contents are read only where a
column needs them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.functions import fixed

_LISTING = "path string, modificationTime timestamp, length long, content binary"
REQUIRED_PARTS = ("metadata", "nodes", "scaler")


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder, empty ones too; a folder that does not exist has none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        found = reader.load(path)
        return found.unionByName(_empty_files(found))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LISTING)


def _plain(path: str) -> str:
    """A file's address with one slash behind the scheme, without escapes."""
    return re.sub(r"^([A-Za-z][\w.+-]*):/+", r"\1:/", path)


def _empty_files(found: DataFrame) -> DataFrame:
    """The files of a listing without any byte, which Spark's scans pass over.

    The driver has the names of all files for its own index already; only the
    few that no scan returns are looked up.
    """
    spark = found.sparkSession
    scanned = {_plain(r["path"]) for r in found.select("path").collect()}
    left = [name for name in map(unquote, found.inputFiles()) if _plain(name) not in scanned]
    conf, rows = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in left:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        rows.append((status.getPath().toString(), status.getModificationTime()))
    return spark.createDataFrame(rows, "path string, ms long").select(
        "path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def export_catalog(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Name, path, size, change time and SHA-256 of each file, newest first."""
    return listing(spark, path, pattern).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "path",
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("sha256"),
    ).orderBy(F.desc("modified_at"), "path")


def storage_stats(spark: SparkSession, areas: Mapping[str, str]) -> DataFrame:
    """Files and bytes per area, with one row ``total``."""
    parts = [
        listing(spark, path).select(F.lit(area).alias("area"), "length")
        for area, path in areas.items()
    ]
    files = reduce(DataFrame.unionByName, parts)
    counted = files.rollup("area").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )
    return counted.select(F.coalesce("area", F.lit("total")).alias("area"), "files", "bytes")


def storage_findings(
    spark: SparkSession, models: str, exports: str, logs: str, versions: DataFrame | None = None
) -> DataFrame:
    """Rows (area, item, finding): incomplete or empty models, broken exports, empty logs.

    ``versions`` (column version) names the models that should be there; one
    without any file is reported as empty.
    """
    below = F.regexp_replace("path", ".*?" + models.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    parts = (
        listing(spark, models).select(F.split(below, "/").alias("_p")).filter(F.size("_p") > 2)
        .groupBy(F.col("_p")[0].alias("item"))
        .agg(F.collect_set(F.when(F.col("_p")[1].isin(*REQUIRED_PARTS), F.col("_p")[1])).alias("_have"))
    )
    wanted = F.array(*[F.lit(p) for p in REQUIRED_PARTS])
    missing = parts.select(
        "item", F.explode(F.array_except(wanted, "_have")).alias("_part")
    ).select(F.lit("models").alias("area"), "item", F.concat(F.lit("missing_"), "_part").alias("finding"))
    found = [missing]
    if versions is not None:
        found.append(
            versions.select(F.col("version").alias("item")).join(parts, "item", "left_anti")
            .select(F.lit("models").alias("area"), "item", F.lit("empty_model").alias("finding"))
        )
    text = F.decode("content", "UTF-8")
    found.append(
        listing(spark, exports).filter(F.json_object_keys(text).isNull())
        .select(F.lit("exports").alias("area"), F.col("path").alias("item"), F.lit("invalid_json").alias("finding"))
    )
    found.append(
        listing(spark, logs).filter("length = 0")
        .select(F.lit("logs").alias("area"), F.col("path").alias("item"), F.lit("empty_log").alias("finding"))
    )
    return reduce(DataFrame.unionByName, found)


def retention_candidates(files: DataFrame, now: Column, days: float, modified: str = "modificationTime") -> DataFrame:
    """Rows last changed more than ``days`` before ``now``.  Nothing is deleted."""
    return files.filter(F.col(modified) < now - F.make_dt_interval(days=F.lit(0), secs=F.lit(days * 86400.0)))


def surplus_models(models: DataFrame, keep: int = fixed.KEEP_MODELS,
                   created: str = "created_at", version: str = "version") -> DataFrame:
    """All models but the ``keep`` newest.  Nothing is deleted."""
    newest = models.orderBy(F.desc(created), F.desc(version)).limit(keep).select(version)
    return models.join(newest, version, "left_anti")
