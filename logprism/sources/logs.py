"""Device logs as tables, and service logs as JSON lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.functions.formats import parse_iso
from logprism.sources.exports import RECORD_FIELDS
from logprism.sources.files import listing

#: Bytes that a tail reads at once, going backwards.
TAIL_BLOCK = 64 << 10
TAIL = pa.schema([("file", pa.string()), ("from_end", pa.int64()), ("value", pa.string()), ("bytes_read", pa.int64())])
TAIL_DDL = "file string, from_end long, value string, bytes_read long"


def read_logs(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Log records from Parquet, ORC, CSV or JSON lines; ``log_ts`` is always a TIMESTAMP.

    These formats split, unlike export documents.
    """
    reader = spark.read
    if file_format == "json":
        df = reader.schema(RECORD_FIELDS).json(path)
    elif file_format == "csv":
        df = reader.option("header", True).option("escape", '"').csv(path)
    else:
        df = reader.format(file_format).load(path)
    if "log_ts" in df.columns:
        return df.withColumn("log_ts", F.col("log_ts").cast("timestamp"))
    return df.withColumn("log_ts", parse_iso(F.col("timestamp")))


def write_logs(logs: DataFrame, path: str, ts: str = "log_ts", mode: str = "append") -> None:
    """Store records as Parquet by day, so later time filters prune files."""
    logs.withColumn("log_date", F.to_date(ts)).write.mode(mode).partitionBy("log_date").parquet(path)


def select_training_logs(
    logs: DataFrame, start: str | None = None, end: str | None = None,
    programs: Iterable[str] = fixed.WIFI_PROCESSES, max_records: int | None = None,
    order: Iterable[str] = ("log_ts",), ts: str = "log_ts", process: str = "process_name",
) -> DataFrame:
    """Records of some programs in [start, end]; with a cap, the earliest ones."""
    out = within(logs, start, end, ts).filter(F.col(process).isin(list(programs)))
    return out if max_records is None else out.orderBy(*order).limit(max_records)


def between(ts: Column, start: str | None, end: str | None) -> Column:
    """Closed interval; an absent end is open."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        condition = condition & (ts <= F.lit(end).cast("timestamp_ntz"))
    return condition


def within(logs: DataFrame, start: str | None, end: str | None, ts: str = "log_ts") -> DataFrame:
    """Rows in the closed interval; tables written by day are pruned to its days."""
    out = logs.filter(between(F.col(ts), start, end))
    if "log_date" in logs.columns:
        if start is not None:
            out = out.filter(F.col("log_date") >= F.to_date(F.lit(start)))
        if end is not None:
            out = out.filter(F.col("log_date") <= F.to_date(F.lit(end)))
    return out


def parse_service_lines(lines: DataFrame, value: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """JSON lines to log_ts, level, logger, message, module, function, line, extra, beside the columns to keep.

    Blank and broken lines are dropped, as are lines that are no objects.
    """
    fields = F.from_json(F.col(value), "map<string,string>")
    parsed = lines.select(*keep, fields.alias("_f")).filter(F.col("_f").isNotNull())
    get = lambda name: F.try_element_at("_f", F.lit(name))
    return parsed.select(
        *keep, parse_iso(get("timestamp")).alias("log_ts"),
        *[get(f).alias(f) for f in ("level", "logger", "message", "module", "function")],
        get("line").try_cast("int").alias("line"),
        F.map_filter("_f", lambda k, _: ~k.isin(list(fixed.SERVICE_FIELDS))).alias("extra"),
    )


def read_service_logs(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Service log rows; ``newest`` keeps only that many latest rows, of equal times the first by their other fields."""
    rows = parse_service_lines(spark.read.text(path))
    if newest is None:
        return rows
    ties = ["level", "logger", "message", "module", "function", "line", F.to_json("extra")]
    return rows.orderBy(F.desc("log_ts"), *ties).limit(newest)


def last_lines(file: pa.NativeFile, lines: int) -> tuple[list[bytes], int]:
    """The last lines of a file, last one first, and the bytes read for them.

    Lines end with LF, CR LF or CR; a line end behind the last line starts no new one.
    """
    at, data = file.size(), b""
    while at > 0:
        step = min(max(TAIL_BLOCK, len(data)), at)  # twice as far each time: long lines are not read over and over
        at -= step
        file.seek(at)
        data = file.read(step) + data
        ends = data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n")
        if ends > lines + 1:  # the first line may be cut, and a CR LF may be cut before it
            break
    found = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").removesuffix(b"\n").split(b"\n") if data else []
    return found[:-lines - 1:-1], len(data)


def tail_lines(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """``file, from_end, value, bytes_read``: the last lines of each file below a path, 1 being the last.

    Tasks take whole files, and of each only its end, in blocks backwards: what
    is read follows ``lines`` and not the files.  Files lie in a store that
    Arrow opens by its address (local, HDFS, S3, GCS, Azure) and are not compressed.
    """
    if lines < 1:
        raise ValueError("at least one line")
    files = listing(spark, path).select("path", "length").filter("length > 0")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["path"].to_pylist():
                store, place = pafs.FileSystem.from_uri(name)
                with store.open_input_file(place) as file:
                    found, size = last_lines(file, lines)
                texts = [line.decode("utf-8", "replace") for line in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int64()),
                    pa.array(texts, pa.string()), pa.array([size] * len(texts), pa.int64())], schema=TAIL)

    # one row a file; dealt out by name, so that many small files do not become one task
    return files.repartition("path").mapInArrow(read, TAIL_DDL)


def read_service_tail(spark: SparkSession, path: str, lines: int) -> DataFrame:
    """Service log rows from the last ``lines`` lines of each file, with ``file`` and ``from_end``; blank and broken lines count."""
    return parse_service_lines(tail_lines(spark, path, lines), keep=("file", "from_end"))


def write_service_logs(service: DataFrame, path: str, mode: str = "append") -> None:
    """Store parsed service rows as Parquet by day, with the level in upper case beside the stated one.

    Searches of the stored table skip other days' files and push the level to
    the scan; text lines would have to be parsed for every search.  Rows
    without a time go to the folder of the null day.
    """
    keyed = service.withColumns({"log_date": F.to_date("log_ts"), "level_key": F.upper("level")})
    # a day's rows come from a few tasks, however many files they were read from
    days = keyed.repartition("log_date", F.pmod(F.xxhash64("log_ts", "message"), F.lit(8)))
    days.sortWithinPartitions("log_date", "level_key").write.mode(mode).partitionBy("log_date").parquet(path)


def write_selection(logs: DataFrame, path: str, file_format: str = "json", level: str | None = None,
                    start: str | None = None, end: str | None = None,
                    level_column: str = "level", ts: str = "log_ts") -> None:
    """Write the rows of one level and time span as JSON lines or CSV."""
    if file_format not in ("json", "csv"):
        raise ValueError(f"unsupported format {file_format!r}")
    out = within(logs, start, end, ts)
    if level is not None:
        out = out.filter(F.upper(level_column) == level.upper())
    writer = out.write
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(file_format).save(path)
