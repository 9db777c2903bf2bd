"""Summaries, search and statistics of logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.functions import fixed
from logprism.sources.logs import within


def top_values(logs: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Most frequent values (ties by value); absent ones count as 'unknown'."""
    return (
        logs.groupBy(F.coalesce(column, F.lit("unknown")).alias(column))
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(top)
    )


def value_distribution(logs: DataFrame, column: str) -> DataFrame:
    return logs.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def message_stats(logs: DataFrame, message: str = "message", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, smallest and largest message length; an absent message has length 0."""
    length = F.length(F.coalesce(message, F.lit("")))
    return logs.groupBy(*keys).agg(
        F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.min(length), F.lit(0)).cast("long").alias("min_length"),
        F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_length"),
    )


def time_range(logs: DataFrame, ts: str = "log_ts", keys: Sequence[str] = ()) -> DataFrame:
    """First and last instant, and the hours between them."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return logs.groupBy(*keys).agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"),
        ((F.max(micros) - F.min(micros)) / 3.6e9).alias("duration_hours"),
    )


def _distributions(records: DataFrame, top: int = 10) -> DataFrame:
    """Per file: the most frequent processes and all levels, as maps, from one scan."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("_c"), F.coalesce(c, F.lit("unknown")).alias("_v"))
        for c in ("process_name", "log_level")
    ])
    counted = records.select("file", F.inline(pairs)).groupBy("file", "_c", "_v").agg(
        F.count("*").alias("_n"))
    order = Window.partitionBy("file", "_c").orderBy(F.desc("_n"), F.asc("_v"))
    kept = counted.withColumn("_k", F.row_number().over(order)).filter(
        (F.col("_k") <= top) | (F.col("_c") == "log_level"))

    def as_map(column: str) -> Column:
        entry = F.when(F.col("_c") == column, F.struct("_v", "_n"))
        return F.map_from_entries(F.collect_list(entry)).alias(f"{column}_distribution")

    return kept.groupBy("file").agg(as_map("process_name"), as_map("log_level"))


def export_summary(records: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """One row per export file: counts, distributions, lengths, time range, validity."""
    length = F.length(F.coalesce("message", F.lit("")))
    micros = F.unix_micros(F.col("log_ts").cast("timestamp"))
    base = records.groupBy("file").agg(
        F.count("*").alias("record_count"), F.avg(length).alias("avg_length"),
        F.min(length).cast("long").alias("min_length"), F.max(length).cast("long").alias("max_length"),
        F.min("log_ts").alias("start_time"), F.max("log_ts").alias("end_time"),
        ((F.max(micros) - F.min(micros)) / 3.6e9).alias("duration_hours"),
    ).join(_distributions(records), "file")
    if report is None:
        return base
    return report.select("file", "size_bytes", "is_valid").join(base, "file", "left").withColumn(
        "record_count", F.coalesce("record_count", F.lit(0)))


# --- service logs --------------------------------------------------------------

def job_related(logs: DataFrame) -> DataFrame:
    """Rows whose message or logger mentions a job keyword."""
    pattern = "|".join(fixed.JOB_KEYWORDS)
    text = lambda c: F.coalesce(F.lower(c).rlike(pattern), F.lit(False))
    return logs.filter(text("message") | text("logger"))


def job_id(message: Column, extra: Column) -> Column:
    """Job id from the extra fields, else from a message that mentions it."""
    text = F.lower(message)
    found = F.nullif(F.regexp_extract(text, fixed.JOB_ID_PATTERN, 1), F.lit(""))
    inside = F.when(text.contains("training_id"), found)
    return F.when(F.map_contains_key(extra, "training_id"), F.try_element_at(extra, F.lit("training_id"))).otherwise(inside)


def job_progress(message: Column, extra: Column) -> Column:
    """Progress in percent from the extra fields, else from a message that mentions it."""
    text = F.lower(message)
    inside = F.when(text.contains("progress"), F.regexp_extract(text, fixed.PROGRESS_PATTERN, 1).try_cast("double"))
    given = F.try_element_at(extra, F.lit("progress")).try_cast("double")
    return F.when(F.map_contains_key(extra, "progress"), given).otherwise(inside)


def job_logs(service: DataFrame) -> DataFrame:
    """Job-related service rows with ``training_id``, ``progress`` and ``step``."""
    return job_related(service).withColumns({
        "training_id": job_id(F.col("message"), F.col("extra")),
        "progress": job_progress(F.col("message"), F.col("extra")),
        "step": F.try_element_at("extra", F.lit("step")),
    })


def search(
    logs: DataFrame, training_id: str | None = None, level: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Rows of one job, one level (any case), and the closed interval [start, end].

    Tables of ``write_service_logs`` are searched by their ``level_key``, which
    the scan can skip by.
    """
    out = within(logs, start, end)
    if training_id is not None:
        out = out.filter(F.col("training_id") == training_id)
    if level is not None:
        key = F.col("level_key") if "level_key" in logs.columns else F.upper("level")
        out = out.filter(key == level.upper())
    return out


def page(found: DataFrame, limit: int = 100, offset: int = 0, ties: Sequence[str] = ()) -> DataFrame:
    """One page of search results, newest first."""
    return found.orderBy(F.desc("log_ts"), *ties).offset(offset).limit(limit)


def page_info(found: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Total number of hits, page number and page size."""
    return found.agg(F.count("*").alias("total")).withColumns({
        "page": F.lit(offset // limit + 1), "page_size": F.lit(limit),
    })


def text_search(logs: DataFrame, term: str = "", level: str | None = None, service: str | None = None,
                columns: Sequence[str] = ("message", "service", "level"),
                start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows that contain the term in any column (any case), with exact level and service."""
    out = within(logs, start, end)
    if term:
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(term.lower())), F.lit(False))
        out = out.filter(hit)
    if level is not None:
        out = out.filter(F.col("level") == level)
    if service is not None:
        out = out.filter(F.col("service") == service)
    return out


def log_stats(jobs: DataFrame, now: Column) -> DataFrame:
    """Total rows, rows of the last 24 hours, jobs, active jobs, rows with progress."""
    recent = F.coalesce(F.col("log_ts") >= now - F.expr("interval 24 hours"), F.lit(True))
    per_job = jobs.groupBy("training_id").agg(
        F.count("*").alias("_n"), F.count_if(recent).alias("_recent"),
        F.count("progress").alias("_progress"),
    )
    named = F.col("training_id").isNotNull()
    zero = F.lit(0)
    return per_job.agg(
        F.coalesce(F.sum("_n"), zero).alias("total_logs"),
        F.coalesce(F.sum("_recent"), zero).alias("logs_last_day"),
        F.count_if(named & (F.col("_n") > fixed.ACTIVE_JOB_ROWS)).alias("active_jobs"),
        F.count_if(named).alias("jobs"),
        F.coalesce(F.sum("_progress"), zero).alias("progress_logs"),
    )


def level_counters(logs: DataFrame, level: str = "level") -> DataFrame:
    """Four counters in one row."""
    names = ("INFO", "WARNING", "ERROR", "DEBUG")
    return logs.agg(*[F.count_if(F.col(level) == n).alias(n.lower()) for n in names])
