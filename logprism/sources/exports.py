"""Export documents: one JSON object per file with metadata and a record array.

A document is one JSON value, so one file is one task.  For repeated work
convert the records once with :func:`logprism.sources.logs.write_logs`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.functions.formats import parse_iso

RECORD_FIELDS = (
    "id string, device_id string, device_ip string, timestamp string, message string, "
    "raw_message string, process_name string, log_level string, structured_data map<string, string>, "
    "pushed_to_ai boolean, pushed_at string, push_attempts long, last_push_error string"
)
DOCUMENT_SCHEMA = (
    "export_metadata struct<export_id: string, created_at: string, total_records: long, format: string, "
    f"start_date: string, end_date: string, programs: array<string>>, data array<struct<{RECORD_FIELDS}>>"
)


def read_export(spark: SparkSession, path: str, require_data: bool = True) -> DataFrame:
    """One row per record, in file order: file, record_idx, log_ts and the record fields.

    ``path`` is a file, a folder or a glob.  A document without ``data`` is an
    error when the rows are read, or contributes nothing if not required.
    """
    docs = (
        spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True)
        .option("recursiveFileLookup", True).json(path)
        .select("data", F.col("_metadata.file_path").alias("file"))
    )
    data = F.col("data")
    if require_data:
        message = F.concat(F.lit("no data section in "), F.col("file"))
        data = F.when(data.isNull(), F.raise_error(message)).otherwise(data)
    records = docs.select("file", F.posexplode(data).alias("record_idx", "_r"))
    return records.select(
        "file", F.col("record_idx").cast("long").alias("record_idx"),
        parse_iso(F.col("_r.timestamp")).alias("log_ts"), "_r.*",
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents as text: file, size_bytes, body.  Nothing is parsed yet."""
    return (
        spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)  # the argument, unlike the option, is kept
        .select(F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_size").alias("size_bytes"),
                F.col("value").alias("body"))
    )


def write_documents(docs: DataFrame, path: str, name: str = "name", body: str = "body") -> None:
    """Write whole documents, one file each: ``body`` as it is, to ``name`` below a new folder.

    For many small documents: Spark's own writer takes a folder and several
    processes for each.  Names may hold folders; where they keep these to some
    thousand files, listings are quick.  The tasks write to a folder beside
    ``path`` that gets its name once all have ended, so a failed job leaves no
    part of them.
    """
    context = docs.sparkSession.sparkContext
    target, beside = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + "-unfinished"))
    system = target.getFileSystem(context._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    system.mkdirs(beside)
    folder = re.sub("^file:/+", "file:///", system.makeQualified(beside).toUri().toString())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for place, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                file = f"{base}/{place}"
                above = file.rsplit("/", 1)[0]
                if above not in made:
                    files.create_dir(above, recursive=True)
                    made.add(above)
                with files.open_output_stream(file, compression=None) as stream:
                    stream.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        docs.select(name, body).mapInArrow(write, "n long").agg(F.sum("n")).collect()
        if not system.rename(beside, target):
            raise OSError(f"cannot rename to {path}")
    finally:
        system.delete(beside, True)


def write_export(logs: DataFrame, path: str, file_column: str, order: str, created_at: str) -> None:
    """Write documents, one per value of ``file_column``.

    Each value becomes one JSON document with a record a line.  No document is
    held as a whole: its records are sorted on disk and written one by one, so
    documents may be of any size; each is written by one task.  Absent fields
    are left out.
    """
    fields = [c for c in logs.columns if c not in (file_column, order)]
    records = logs.select(file_column, F.col(order).alias("_o"), F.to_json(F.struct(*fields)).alias("_r"))
    within = Window.partitionBy(file_column).orderBy("_o", "_r")
    total = F.count("*").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    numbered = records.withColumns({"_n": total, "_k": F.row_number().over(within)})
    metadata = F.to_json(F.struct(F.struct(
        F.lit(created_at).alias("created_at"), F.col("_n").alias("total_records"), F.lit("json").alias("format")
    ).alias("export_metadata")))
    # the opening object without its last brace goes on with the data
    opening = F.when(F.col("_k") == 1, F.concat(F.expr("substring(_m, 1, length(_m) - 1)"), F.lit(',"data":['))).otherwise(",")
    closing = F.when(F.col("_k") == F.col("_n"), "]}").otherwise("")
    lines = numbered.withColumn("_m", F.when(F.col("_k") == 1, metadata)).select(
        file_column, F.concat(opening, "_r", closing).alias("value"))
    lines.write.partitionBy(file_column).text(path)


def export_info(spark: SparkSession, path: str) -> DataFrame:
    """Per file: size, record count, whether metadata is there, and its fields."""
    docs = (
        spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True)
        .option("recursiveFileLookup", True).json(path)
    )
    return docs.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.coalesce(F.size("data"), F.lit(0)).cast("long").alias("record_count"),
        F.col("export_metadata").isNotNull().alias("has_metadata"),
        "export_metadata.created_at", "export_metadata.total_records", "export_metadata.format",
    )
