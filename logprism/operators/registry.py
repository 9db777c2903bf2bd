"""Queries over model metadata and training jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LISTED = ("version", "model_type", "created_at", "training_samples", "status")


def list_models(models: DataFrame, columns: Sequence[str] = _LISTED) -> DataFrame:
    """Models, newest first."""
    return models.select(*columns).orderBy(F.desc("created_at"), F.desc("version"))


def filter_models(models: DataFrame, status: str | None = None, model_type: str | None = None,
                  limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filtered page, newest first; status 'available' is shown and asked for as 'ready'."""
    shown = models.withColumn("status", F.when(F.col("status") == "available", "ready").otherwise(F.col("status")))
    if status is not None:
        shown = shown.filter(F.col("status") == status)
    if model_type is not None:
        shown = shown.filter(F.col("model_type") == model_type)
    out = list_models(shown)
    return out if limit is None else out.offset(offset).limit(limit)


def get_model(models: DataFrame, version: str) -> DataFrame:
    return models.filter(F.col("version") == version)


def model_exists(models: DataFrame, version: str) -> DataFrame:
    return get_model(models, version).agg((F.count("*") > 0).alias("exists"))


def latest_model(models: DataFrame, deployed: bool = False) -> DataFrame:
    """The newest model, or the newest deployed one; no row if there is none."""
    chosen = models.filter("status = 'deployed'") if deployed else models
    row = F.struct(*models.columns)
    newest = chosen.agg(F.max_by(row, F.struct("created_at", "version")).alias("_m"))
    return newest.filter(F.col("_m").isNotNull()).select("_m.*")


def model_stats(models: DataFrame) -> DataFrame:
    """Totals over all models in one row."""
    return models.agg(
        F.count("*").alias("total_models"),
        F.count_if(F.col("status") == "deployed").alias("deployed_models"),
        F.count_if(F.col("status") == "available").alias("available_models"),
        F.coalesce(F.sum("training_samples"), F.lit(0)).alias("total_training_samples"),
        F.min("created_at").alias("oldest_model"), F.max("created_at").alias("newest_model"),
    )


def model_types(models: DataFrame) -> DataFrame:
    return models.groupBy("model_type").agg(F.count("*").alias("n"))


def search_models(models: DataFrame, term: str = "", status: str | None = None, stable: bool = False,
                  columns: Sequence[str] = ("version", "model_type")) -> DataFrame:
    """Models that contain the term (any case); stable ones are no alpha or beta."""
    out = models
    if term:
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.coalesce(F.contains(F.lower(column), F.lit(term.lower())), F.lit(False))
        out = out.filter(hit)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if stable:
        out = out.filter(~F.col("version").rlike("alpha|beta"))
    return out


def storage_and_version(models: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Bytes of all models and the highest dotted version."""
    # trailing zeros do not make a version higher: 1.2 equals 1.2.0
    number = F.regexp_replace(F.regexp_extract("version", r"([0-9.]+)", 1), r"(\.0*)+$", "")
    parts = F.transform(
        F.split(number, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
    return models.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("storage_bytes"),
        F.max_by("version", F.struct(parts, "version")).alias("latest_version"),
    )


# --- jobs ----------------------------------------------------------------------

def job_status(error: Column, result: Column) -> Column:
    """State after an event: an error beats a result, anything else is running."""
    return F.when(error.isNotNull(), "failed").when(result.isNotNull(), "completed").otherwise("running")


def latest_jobs(events: DataFrame) -> DataFrame:
    """State of each job after its last event.

    Events: training_id, event_time, progress, step, error, result.  The last
    event is a maximum, so a job with very many events is combined map-side.
    """
    event = F.struct("event_time", "progress", "step", "error", "result")
    last = events.groupBy("training_id").agg(F.max(event).alias("_e"), F.min("event_time").alias("started_at"))
    return last.select(
        "training_id", job_status(F.col("_e.error"), F.col("_e.result")).alias("status"),
        F.col("_e.progress").alias("progress"), F.col("_e.step").alias("step"),
        "started_at", F.col("_e.event_time").alias("updated_at"),
    )


def list_jobs(events: DataFrame, models: DataFrame) -> DataFrame:
    """Live jobs, and finished ones known only from the model registry."""
    live = latest_jobs(events)
    stored = (
        models.filter(F.col("training_id").isNotNull())
        .groupBy("training_id").agg(F.max("created_at").alias("created_at"))
        .join(live, "training_id", "left_anti")
        .select(
            "training_id", F.lit("completed").alias("status"), F.lit(100.0).alias("progress"),
            F.lit("Training completed").alias("step"),
            F.col("created_at").alias("started_at"), F.col("created_at").alias("updated_at"),
        )
    )
    return live.unionByName(stored)


def filter_jobs(jobs: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    out = jobs if status is None else jobs.filter(F.col("status") == status)
    return out.orderBy(F.desc("updated_at"), "training_id").offset(offset).limit(limit)


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def stale_jobs(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Finished jobs older than ``days``.  Nothing is deleted."""
    done = jobs.filter(F.col("status").isin("completed", "failed"))
    return done.filter(F.col("updated_at") < now - F.make_dt_interval(F.lit(days)))


def evaluation_rollup(jobs: DataFrame) -> DataFrame:
    """Pass and fail percentage and mean metrics of evaluated, completed jobs.

    Jobs: status, evaluated, all_passed, accuracy, f1_score (null counts as 0).
    """
    done = jobs.filter((F.col("status") == "completed") & F.col("evaluated"))
    passed = F.coalesce(F.avg(F.coalesce("all_passed", F.lit(False)).cast("double")), F.lit(0.0)) * 100
    any_job = F.count("*") > 0
    return done.agg(
        F.count("*").alias("evaluated_jobs"),
        F.round(passed, 1).alias("pass_rate"),
        F.when(any_job, F.round(100 - passed, 1)).otherwise(0.0).alias("fail_rate"),
        F.coalesce(F.round(F.avg(F.coalesce("accuracy", F.lit(0.0))) * 100, 1), F.lit(0.0)).alias("avg_accuracy"),
        F.coalesce(F.round(F.avg(F.coalesce("f1_score", F.lit(0.0))) * 100, 1), F.lit(0.0)).alias("avg_f1_score"),
    )


def recent_advice(jobs: DataFrame, newest: int = 10, top: int = 5) -> DataFrame:
    """Advice of the newest evaluated jobs, most urgent first.

    ``advice`` is an array of structs (priority, text).
    """
    recent = (
        jobs.filter((F.col("status") == "completed") & F.col("evaluated"))
        .orderBy(F.desc("updated_at"), "training_id").limit(newest)
    )
    urgency = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    return (
        recent.select("training_id", "updated_at", F.inline("advice"))
        .orderBy(urgency.desc(), F.desc("updated_at"), "training_id", "text").limit(top)
    )
