"""Log analytics, service logs, model registry and job queries."""

from pyspark.sql import functions as F

from checks.views import (
    EVALUATED, JOB_EVENTS, MODELS, SERVICE, evaluated, job_events, logs, models, service, with_logs, with_view,
)
from logprism.functions import fixed
from logprism.operators import loganalytics as la
from logprism.operators import registry as rg
from logprism.session import run_dir
from logprism.sources import files
from logprism.sources import logs as log_source


def _service(spark, sf_dir):
    """Service rows read back from JSON lines, with blank and broken lines between."""
    path = run_dir(spark, "service")
    rows = service(spark, sf_dir)
    line = F.to_json(F.struct(
        F.date_format("log_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "level", "logger", "message",
        "line", F.lit("mod").alias("module"), F.col("x_training_id").alias("training_id"),
        F.col("x_progress").alias("progress"), F.col("x_step").alias("step"),
    ))
    key = F.col("line")
    text = F.when(key % 41 == 7, F.lit("no json {")).when(key % 43 == 11, F.lit("  ")).otherwise(line)
    rows.select(text.alias("value")).write.text(path)
    return log_source.read_service_logs(spark, path)


def _micros(df, *names):
    return df.withColumns({n: F.unix_micros(F.col(n).cast("timestamp")) for n in names})


def select_logs(spark, sf_dir):
    out = log_source.select_training_logs(
        logs(spark, sf_dir), "2024-01-03 00:00:00", "2024-01-20 12:00:00", max_records=2000, order=("log_ts", "record_id"))
    return out.select("record_id", "process_name")


def log_table_round_trip(spark, sf_dir):
    path = run_dir(spark, "logs")
    log_source.write_logs(logs(spark, sf_dir), path)
    return log_source.read_logs(spark, path).groupBy(F.col("log_date").cast("string").alias("log_date"), "log_level").agg(
        F.count("*").alias("n"), F.sum("record_id").alias("ids"))


def log_export_json(spark, sf_dir):
    path = run_dir(spark, "selection")
    rows = logs(spark, sf_dir).select("record_id", "log_ts", "message", F.col("log_level").alias("level"))
    log_source.write_selection(rows, path, "json", "error", "2024-01-05 00:00:00", "2024-01-15 00:00:00")
    return spark.read.schema("record_id long, message string, level string").json(path)


def log_export_csv(spark, sf_dir):
    path = run_dir(spark, "selection")
    rows = logs(spark, sf_dir).select("record_id", "log_ts", "message", F.col("log_level").alias("level"))
    log_source.write_selection(rows, path, "csv", "warning")
    return log_source.read_logs(spark, path, "csv").select(F.col("record_id").cast("long").alias("record_id"), "message", "level")


def message_stats(spark, sf_dir):
    return la.message_stats(logs(spark, sf_dir)).withColumn("avg_length", F.round("avg_length", 6))


def time_range(spark, sf_dir):
    out = la.time_range(logs(spark, sf_dir))
    return _micros(out, "start_time", "end_time").withColumn("duration_hours", F.round("duration_hours", 6))


def service_rows(spark, sf_dir):
    rows = _service(spark, sf_dir)
    return rows.select("line", F.unix_micros("log_ts").alias("micros"), "level", "logger", "message",
                       F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("extras"))


def log_keyword_filter(spark, sf_dir):
    return la.job_related(_service(spark, sf_dir)).select("line")


def _jobs(spark, sf_dir):
    return la.job_logs(_service(spark, sf_dir))


def _stored_jobs(spark, sf_dir):
    """The job rows as a table by day."""
    path = run_dir(spark, "service")
    log_source.write_service_logs(_jobs(spark, sf_dir), path)
    return spark.read.parquet(path)


def log_job_fields(spark, sf_dir):
    return _jobs(spark, sf_dir).select("line", "training_id", "progress", "step")


def log_search(spark, sf_dir):
    found = la.search(_stored_jobs(spark, sf_dir), level="error", start="2024-01-02 00:00:00", end="2024-01-25 00:00:00")
    return la.page(found, limit=50, offset=20, ties=["line"]).select("line", "training_id")


def log_search_job(spark, sf_dir):
    return la.search(_stored_jobs(spark, sf_dir), training_id="job-12").select("line", "level")


def log_search_total(spark, sf_dir):
    found = la.search(_stored_jobs(spark, sf_dir), level="error", start="2024-01-02 00:00:00", end="2024-01-25 00:00:00")
    return la.page_info(found, limit=50, offset=120)


def log_text_search(spark, sf_dir):
    rows = service(spark, sf_dir).withColumn("service", F.col("logger"))
    return la.text_search(rows, "TRAIN", service="svc.pipe", level="ERROR").select("line")


def log_text_search_any(spark, sf_dir):
    rows = service(spark, sf_dir).withColumn("service", F.col("logger"))
    return la.text_search(rows, "features", start="2024-01-03 00:00:00").select("line")


def log_stats(spark, sf_dir):
    return la.log_stats(_jobs(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp"))


def level_counters(spark, sf_dir):
    return la.level_counters(_service(spark, sf_dir))


def model_list(spark, sf_dir):
    return _micros(rg.list_models(models(spark, sf_dir)), "created_at")


def model_page(spark, sf_dir):
    out = rg.filter_models(models(spark, sf_dir), status="ready", model_type="isolation_forest", limit=30, offset=15)
    return _micros(out, "created_at")


def _one(deployed):
    return lambda spark, sf_dir: rg.latest_model(models(spark, sf_dir), deployed).select("version", "status", "training_samples")


def model_stats(spark, sf_dir):
    return _micros(rg.model_stats(models(spark, sf_dir)), "oldest_model", "newest_model")


def retention_models(spark, sf_dir):
    return files.surplus_models(models(spark, sf_dir), keep=5).select("version")


def retention_by_age(spark, sf_dir):
    now = F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")
    return files.retention_candidates(models(spark, sf_dir), now, 30, "created_at").select("version")


def _all_jobs(spark, sf_dir):
    return rg.list_jobs(job_events(spark, sf_dir), models(spark, sf_dir))


def job_list(spark, sf_dir):
    out = _all_jobs(spark, sf_dir)
    return _micros(out, "started_at", "updated_at")


def job_page(spark, sf_dir):
    return rg.filter_jobs(_all_jobs(spark, sf_dir), "failed", 20, 3).select("training_id", "step")


def stale_jobs(spark, sf_dir):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return rg.stale_jobs(_all_jobs(spark, sf_dir), now, 1).select("training_id", "status")


def recent_advice(spark, sf_dir):
    level = F.when(F.col("urgency").isin("1-URGENT", "2-HIGH"), "high").when(F.col("urgency") == "3-MEDIUM", "medium").otherwise("low")
    rows = evaluated(spark, sf_dir).withColumn("advice", F.array(
        F.struct(level.alias("priority"), F.lit("first").alias("text")),
        F.struct(F.lit("low").alias("priority"), F.lit("second").alias("text"))))
    return rg.recent_advice(rows).select("training_id", "priority", "text")


QUERIES = {
    "select_training_logs": select_logs,
    "log_table_round_trip": log_table_round_trip,
    "log_export_json": log_export_json,
    "log_export_csv": log_export_csv,
    "top_processes": lambda s, d: la.top_values(logs(s, d), "process_name"),
    "level_distribution": lambda s, d: la.value_distribution(logs(s, d), "log_level"),
    "message_stats": message_stats,
    "time_range": time_range,
    "service_rows": service_rows,
    "log_keyword_filter": log_keyword_filter,
    "log_job_fields": log_job_fields,
    "log_search": log_search,
    "log_search_job": log_search_job,
    "log_search_total": log_search_total,
    "log_text_search": log_text_search,
    "log_text_search_any": log_text_search_any,
    "log_stats": log_stats,
    "log_level_counters": level_counters,
    "model_list": model_list,
    "model_page": model_page,
    "model_get": lambda s, d: rg.get_model(models(s, d), "1.7.47").select("version", "model_type", "training_samples"),
    "model_exists": lambda s, d: rg.model_exists(models(s, d), "1.7.47"),
    "model_latest": _one(False),
    "model_deployed": _one(True),
    "model_stats": model_stats,
    "model_types": lambda s, d: rg.model_types(models(s, d)),
    "model_search": lambda s, d: rg.search_models(models(s, d), "BETA", status="deployed").select("version"),
    "model_search_stable": lambda s, d: rg.search_models(models(s, d), "outlier", stable=True).select("version"),
    "model_storage": lambda s, d: rg.storage_and_version(models(s, d)),
    "retention_models": retention_models,
    "retention_by_age": retention_by_age,
    "job_list": job_list,
    "job_page": job_page,
    "job_counts": lambda s, d: rg.job_counts(_all_jobs(s, d)),
    "job_stale": stale_jobs,
    "evaluation_rollup": lambda s, d: rg.evaluation_rollup(evaluated(s, d)),
    "recent_advice": recent_advice,
}

# --- SQL --------------------------------------------------------------------

_KEYWORDS = "|".join(fixed.JOB_KEYWORDS)
_JOBS = rf"""rows as (select * from service where line % 41 <> 7 and line % 43 <> 11),
 related as (select * from rows where regexp_matches(lower(message), '{_KEYWORDS}') or regexp_matches(lower(logger), '{_KEYWORDS}')),
 jobs as (select *, case when x_training_id is not null then x_training_id when contains(lower(message), 'training_id')
     then nullif(regexp_extract(lower(message), '{fixed.JOB_ID_PATTERN}', 1), '') end as training_id,
   case when x_progress is not null then x_progress when contains(lower(message), 'progress')
     then try_cast(regexp_extract(lower(message), '{fixed.PROGRESS_PATTERN}', 1) as double) end as progress from related)"""


def _svc(body):
    return with_view("service", SERVICE, body, _JOBS)


def _mod(body, *ctes):
    return with_view("models", MODELS, body, *ctes)


_LISTED = "version, model_type, epoch_us(created_at) as created_at, training_samples"
_NEWEST = "order by models.created_at desc, version desc"
_JOB_STATE = f"""job_events as ({JOB_EVENTS}),
 last as (select *, row_number() over (partition by training_id order by event_time desc) as k, min(event_time) over (partition by training_id) as started_at from job_events),
 live as (select training_id, case when error is not null then 'failed' when result is not null then 'completed' else 'running' end as status,
   progress, step, started_at, event_time as updated_at from last where k = 1),
 stored as (select training_id, 'completed' as status, 100.0 as progress, 'Training completed' as step, created_at as started_at, created_at as updated_at from
   (select *, row_number() over (partition by training_id order by created_at desc, version desc) as k from models where training_id is not null)
   where k = 1 and training_id not in (select training_id from live)),
 alljobs as (select * from live union all select * from stored)"""

SQL = {
    "select_training_logs": with_logs("""select record_id, process_name from logs where process_name in ('hostapd', 'wpa_supplicant')
        and log_ts between timestamp '2024-01-03' and timestamp '2024-01-20 12:00:00' order by log_ts, record_id limit 2000"""),
    "log_table_round_trip": with_logs("""select cast(cast(log_ts as date) as varchar) as log_date, log_level, count(*) as n, cast(sum(record_id) as bigint) as ids from logs group by all"""),
    "log_export_json": with_logs("""select record_id, message, log_level as level from logs where log_level = 'ERROR'
        and log_ts between timestamp '2024-01-05' and timestamp '2024-01-15'"""),
    "log_export_csv": with_logs("select record_id, nullif(message, '') as message, log_level as level from logs where log_level = 'WARNING'"),
    "top_processes": with_logs("select coalesce(process_name, 'unknown') as process_name, count(*) as n from logs group by 1 order by n desc, 1 limit 10"),
    "level_distribution": with_logs("select coalesce(log_level, 'unknown') as log_level, count(*) as n from logs group by 1"),
    "message_stats": with_logs("select round(avg(length(coalesce(message, ''))), 6) as avg_length, min(length(message)) as min_length, max(length(message)) as max_length from logs"),
    "time_range": with_logs("""select epoch_us(min(log_ts)) as start_time, epoch_us(max(log_ts)) as end_time,
        round((epoch_us(max(log_ts)) - epoch_us(min(log_ts))) / 3.6e9, 6) as duration_hours from logs"""),
    "service_rows": _svc("""select line, epoch_us(log_ts) as micros, level, logger, message,
        concat_ws(',', case when x_progress is not null then 'progress' end, case when x_step is not null then 'step' end,
          case when x_training_id is not null then 'training_id' end) as extras from rows"""),
    "log_keyword_filter": _svc("select line from related"),
    "log_job_fields": _svc("select line, training_id, progress, x_step as step from jobs"),
    "log_search": _svc("""select line, training_id from jobs where upper(level) = 'ERROR' and log_ts between timestamp '2024-01-02' and timestamp '2024-01-25'
        order by log_ts desc, line limit 50 offset 20"""),
    "log_search_job": _svc("select line, level from jobs where training_id = 'job-12'"),
    "log_search_total": _svc("""select count(*) as total, 3 as page, 50 as page_size from jobs where upper(level) = 'ERROR'
        and log_ts between timestamp '2024-01-02' and timestamp '2024-01-25'"""),
    "log_text_search": _svc("""select line from service where (contains(lower(message), 'train') or contains(lower(logger), 'train') or contains(lower(level), 'train'))
        and logger = 'svc.pipe' and level = 'ERROR'"""),
    "log_text_search_any": _svc("""select line from service where (contains(lower(message), 'features') or contains(lower(logger), 'features'))
        and log_ts >= timestamp '2024-01-03'"""),
    "log_stats": _svc("""select count(*) as total_logs, count(*) filter (where log_ts >= timestamp '2024-01-14 12:00:00') as logs_last_day,
        (select count(*) from (select training_id from jobs where training_id is not null group by 1 having count(*) > 5)) as active_jobs,
        count(distinct training_id) as jobs, count(progress) as progress_logs from jobs"""),
    "log_level_counters": _svc("""select count(*) filter (where level = 'INFO') as info, count(*) filter (where level = 'WARNING') as warning,
        count(*) filter (where level = 'ERROR') as error, count(*) filter (where level = 'DEBUG') as debug from rows"""),
    "model_list": _mod(f"select {_LISTED}, status from models"),
    "model_page": _mod(f"select {_LISTED}, 'ready' as status from models where status = 'available' and model_type = 'isolation_forest' {_NEWEST} limit 30 offset 15"),
    "model_get": _mod("select version, model_type, training_samples from models where version = '1.7.47'"),
    "model_exists": _mod("select count(*) > 0 as exists from models where version = '1.7.47'"),
    "model_latest": _mod(f"select version, status, training_samples from models {_NEWEST} limit 1"),
    "model_deployed": _mod(f"select version, status, training_samples from models where status = 'deployed' {_NEWEST} limit 1"),
    "model_stats": _mod("""select count(*) as total_models, count(*) filter (where status = 'deployed') as deployed_models, count(*) filter (where status = 'available') as available_models,
        cast(sum(training_samples) as bigint) as total_training_samples, epoch_us(min(created_at)) as oldest_model, epoch_us(max(created_at)) as newest_model from models"""),
    "model_types": _mod("select model_type, count(*) as n from models group by 1"),
    "model_search": _mod("select version from models where contains(lower(version), 'beta') and status = 'deployed'"),
    "model_search_stable": _mod("select version from models where contains(model_type, 'outlier') and not contains(version, 'beta')"),
    "model_storage": _mod("""select cast(sum(size_bytes) as bigint) as storage_bytes, (select version from models order by
        cast(split_part(version, '.', 2) as bigint) desc, cast(replace(split_part(version, '.', 3), '-beta', '') as bigint) desc, version desc limit 1) as latest_version from models"""),
    "retention_models": _mod(f"select version from models where version not in (select version from models {_NEWEST} limit 5)"),
    "retention_by_age": _mod("select version from models where created_at < timestamp '1999-05-02'"),
    "job_list": _mod("select training_id, status, progress, step, epoch_us(started_at) as started_at, epoch_us(updated_at) as updated_at from alljobs", _JOB_STATE),
    "job_page": _mod("select training_id, step from alljobs where status = 'failed' order by updated_at desc, training_id limit 20 offset 3", _JOB_STATE),
    "job_counts": _mod("select status, count(*) as n from alljobs group by 1", _JOB_STATE),
    "job_stale": _mod("select training_id, status from alljobs where status in ('completed', 'failed') and updated_at < timestamp '2024-01-29'", _JOB_STATE),
    "evaluation_rollup": with_view("jobs", EVALUATED, """select count(*) as evaluated_jobs, round(avg(case when all_passed then 1.0 else 0.0 end) * 100, 1) as pass_rate,
        round(100 - avg(case when all_passed then 1.0 else 0.0 end) * 100, 1) as fail_rate, round(avg(coalesce(cast(accuracy as double), 0)) * 100, 1) as avg_accuracy,
        round(avg(cast(f1_score as double)) * 100, 1) as avg_f1_score from jobs where status = 'completed' and evaluated"""),
    "recent_advice": with_view("jobs", EVALUATED, """select training_id, priority, text from (
        select training_id, updated_at, case when urgency in ('1-URGENT', '2-HIGH') then 'high' when urgency = '3-MEDIUM' then 'medium' else 'low' end as priority, 'first' as text from recent
        union all select training_id, updated_at, 'low', 'second' from recent)
        order by case priority when 'high' then 3 when 'medium' then 2 else 1 end desc, updated_at desc, training_id, text limit 5""",
        "recent as (select * from jobs where status = 'completed' and evaluated order by updated_at desc, training_id limit 10)"),
}
