"""Data-quality rules over planted faults, as a table and through export documents."""

from pyspark.sql import functions as F

from checks.views import DIRTY, dirty, logs, with_logs, with_view
from logprism.functions import fixed
from logprism.operators import loganalytics as la
from logprism.operators import quality
from logprism.session import run_dir
from logprism.sources import exports, files


def _fields(spark, sf_dir):
    return quality.table_fields(dirty(spark, sf_dir), "file", "record_id")


def _exported(spark, sf_dir):
    """Folder of export documents made from the dirty records."""
    path = run_dir(spark, "exports")
    exports.write_export(dirty(spark, sf_dir), path, "file", "record_id", "2024-02-01T00:00:00Z")
    return path


def _named(df):
    return df.withColumn("file", F.regexp_extract("file", "file=([^/]+)", 1))


def dq_records(spark, sf_dir):
    return quality.record_violations(_fields(spark, sf_dir))


def dq_lenient(spark, sf_dir):
    return quality.record_violations(_fields(spark, sf_dir), lenient=True)


def dq_order(spark, sf_dir):
    return quality.order_violations(_fields(spark, sf_dir)).select("file", "rule")


def dq_duplicates(spark, sf_dir):
    return quality.duplicate_violations(_fields(spark, sf_dir))


def dq_duplicates_one_file(spark, sf_dir):
    fields = quality.table_fields(dirty(spark, sf_dir), None, "record_id")
    return quality.duplicate_violations(fields).select("record_idx", "rule")


def dq_order_one_file(spark, sf_dir):
    fields = quality.table_fields(dirty(spark, sf_dir), None, "record_id")
    return quality.order_violations(fields).select("rule")


def export_violations(spark, sf_dir):
    docs = exports.read_documents(spark, _exported(spark, sf_dir))
    return _named(quality.validate_documents(docs)).groupBy("file", "rule").agg(F.count("*").alias("n"))


def export_report(spark, sf_dir):
    docs = exports.read_documents(spark, _exported(spark, sf_dir))
    report = quality.validation_report(docs, quality.validate_documents(docs))
    return _named(report).select("file", "is_valid", "error_count")


def export_report_lenient(spark, sf_dir):
    docs = exports.read_documents(spark, _exported(spark, sf_dir))
    return quality.directory_report(quality.validation_report(docs, quality.validate_documents(docs, lenient=True)))


def export_records(spark, sf_dir):
    rows = exports.read_export(spark, _exported(spark, sf_dir))
    return _named(rows).select("file", "record_idx", "process_name", "log_level", "message",
                               F.unix_micros("log_ts").alias("micros"))


def export_summary(spark, sf_dir):
    path = _exported(spark, sf_dir)
    docs = exports.read_documents(spark, path)
    report = quality.validation_report(docs, quality.validate_documents(docs))
    summary = _named(la.export_summary(exports.read_export(spark, path), report))

    def text_of(column):
        entries = F.map_entries(column)
        return F.array_join(F.array_sort(F.transform(
            entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")

    return summary.select(
        "file", "is_valid", "record_count", text_of("process_name_distribution").alias("processes"),
        text_of("log_level_distribution").alias("levels"), F.round("avg_length", 6).alias("avg_length"),
        "min_length", "max_length", F.round("duration_hours", 6).alias("duration_hours"),
    )


def export_info(spark, sf_dir):
    return _named(exports.export_info(spark, _exported(spark, sf_dir))).select(
        "file", "record_count", "has_metadata", "created_at", "total_records", "format")


def export_catalog(spark, sf_dir):
    catalog = files.export_catalog(spark, _exported(spark, sf_dir), "*.txt")
    return _named(catalog.withColumn("file", F.col("path"))).groupBy("file").agg(
        F.count("*").alias("files"), F.max(F.length("sha256")).alias("digest_length"))


def storage_stats(spark, sf_dir):
    areas = {"exports": _exported(spark, sf_dir), "models": run_dir(spark, "nothing")}
    wanted = files.storage_stats(spark, areas)
    return wanted.filter((F.col("bytes") > 0)).groupBy("area").agg(
        F.count("*").alias("rows"), F.max(F.col("files") > 1).alias("many"))


def format_profile(spark, sf_dir):
    mac = F.regexp_extract("message", fixed.MAC, 0)
    ip = F.regexp_extract("message", r"10\.0\.0\.\d+", 0)
    df = logs(spark, sf_dir).select(
        F.when(F.col("device_id") % 9 != 0, mac).alias("mac"), F.concat(ip, F.lit("9")).alias("ip"),
        F.concat(F.col("process_name"), F.lit("@host.example")).alias("mail"),
        F.concat(F.lit("https://"), F.col("process_name"), F.lit("/x")).alias("link"),
    )
    return quality.format_profile(df, {"mac": "mac", "ip": "ipv4", "mail": "email", "link": "url"})


def page_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url")
    return quality.format_profile(pages, {"url": "url"})


def training_suitability(spark, sf_dir):
    out = quality.training_suitability(logs(spark, sf_dir))
    return out.withColumn("wifi_ratio", F.round("wifi_ratio", 6))


def suitability_by_process(spark, sf_dir):
    out = quality.training_suitability(logs(spark, sf_dir), keys=["process_name"])
    return out.withColumn("wifi_ratio", F.round("wifi_ratio", 6))


QUERIES = {
    "dq_records": dq_records,
    "dq_lenient": dq_lenient,
    "dq_order": dq_order,
    "dq_order_one_file": dq_order_one_file,
    "dq_duplicates": dq_duplicates,
    "dq_duplicates_one_file": dq_duplicates_one_file,
    "dq_formats": format_profile,
    "dq_page_urls": page_urls,
    "export_violations": export_violations,
    "export_report": export_report,
    "export_report_lenient": export_report_lenient,
    "export_records": export_records,
    "export_summary": export_summary,
    "export_info": export_info,
    "export_catalog": export_catalog,
    "storage_stats": storage_stats,
    "training_suitability": training_suitability,
    "suitability_by_process": suitability_by_process,
}

# --- SQL --------------------------------------------------------------------

_VALID = (r"regexp_matches(timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$')"
          " and try_cast(timestamp as timestamp) is not null")
_T = f"case when {_VALID} then try_cast(timestamp as timestamp) end"
_RULES = {
    "missing_timestamp": "timestamp is null", "missing_message": "message is null",
    "missing_process_name": "process_name is null", "missing_log_level": "log_level is null",
    "invalid_timestamp": f"timestamp is not null and not ({_VALID})",
    "invalid_log_level": "log_level is not null and log_level not in ('DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL')",
}


def _rules(names, source="dirty", idx="record_id"):
    return " union all ".join(
        f"select file, {idx} as record_idx, '{r}' as rule from {source} where {_RULES[r]}" for r in names)


def _order(by="partition by file"):
    return (f"select distinct file, 'not_chronological' as rule from (select file, t, lag(t) over ({by} order by record_id) as p "
            f"from (select file, record_id, {_T} as t from dirty) where t is not null) where t < p")


def _dups(by="file, "):
    return ("select file, record_id as record_idx, 'duplicate' as rule from (select file, record_id, "
            f"row_number() over (partition by {by}timestamp, message, process_name order by record_id) as k from dirty) where k > 1")


def _dirty(body, *ctes):
    return with_view("dirty", DIRTY, body, *ctes)


_LENIENT = [r for r in _RULES if r != "missing_log_level"]
_ALL = (f"allv as (select file, rule from ({_rules(_RULES)}) union all select file, rule from ({_order()}) "
        f"union all select file, rule from ({_dups()}))")
_REPORT = "report as (select f.file, count(v.rule) = 0 as is_valid, count(v.rule) as error_count from (select distinct file from dirty) f left join allv v using (file) group by 1)"

SQL = {
    "dq_records": _dirty(_rules(_RULES)),
    "dq_lenient": _dirty(_rules(_LENIENT)),
    "dq_order": _dirty(_order()),
    "dq_order_one_file": _dirty(f"select distinct rule from ({_order('')})"),
    "dq_duplicates": _dirty(_dups()),
    "dq_duplicates_one_file": _dirty(f"select record_idx, rule from ({_dups('')})"),
    "dq_formats": with_logs(rf"""select 'mac' as column_name, 'mac' as format, count(*) filter (where device_id % 9 <> 0 and regexp_matches(message, '{fixed.MAC}')) as valid,
        count(*) filter (where device_id % 9 <> 0 and not regexp_matches(message, '{fixed.MAC}')) as invalid, count(*) filter (where device_id % 9 = 0) as absent from logs
        union all select 'ip', 'ipv4', count(*) filter (where ok), count(*) filter (where not ok), 0 from
          (select regexp_matches(regexp_extract(message, '10\.0\.0\.\d+') || '9', '{fixed.IPV4_FORMAT}') as ok from logs)
        union all select 'mail', 'email', count(process_name) filter (where regexp_matches(process_name || '@host.example', '{fixed.EMAIL_FORMAT}')),
          count(process_name) filter (where not regexp_matches(process_name || '@host.example', '{fixed.EMAIL_FORMAT}')), count(*) filter (where process_name is null) from logs
        union all select 'link', 'url', count(process_name), 0, count(*) filter (where process_name is null) from logs"""),
    "dq_page_urls": rf"""select 'url' as column_name, 'url' as format, count(*) filter (where regexp_matches(url, '{fixed.URL_FORMAT}')) as valid,
        count(*) filter (where not regexp_matches(url, '{fixed.URL_FORMAT}')) as invalid, count(*) filter (where url is null) as absent from pages""",
    "export_violations": _dirty("select file, rule, count(*) as n from allv group by all", _ALL),
    "export_report": _dirty("select * from report", _ALL, _REPORT),
    "export_report_lenient": _dirty(f"""select count(*) as total_files, count(*) filter (where n = 0) as valid_files, count(*) filter (where n > 0) as invalid_files from
        (select file, count(rule) as n from (select distinct file from dirty) left join ({_rules(_LENIENT)}) using (file) group by 1)"""),
    "export_records": _dirty(f"""select file, row_number() over (partition by file order by record_id) - 1 as record_idx, process_name, log_level, message,
        epoch_us({_T}) as micros from dirty"""),
    "export_summary": _dirty(f"""select r.file, is_valid, record_count, processes, levels, avg_length, min_length, max_length, duration_hours from report r
        join (select file, count(*) as record_count, round(avg(length(coalesce(message, ''))), 6) as avg_length, min(length(coalesce(message, ''))) as min_length,
          max(length(coalesce(message, ''))) as max_length, round((epoch_us(max({_T})) - epoch_us(min({_T}))) / 3.6e9, 6) as duration_hours from dirty group by 1) using (file)
        join (select file, string_agg(v || '=' || n, ',' order by v || '=' || n) as processes from
          (select file, coalesce(process_name, 'unknown') as v, count(*) as n from dirty group by all) group by 1) using (file)
        join (select file, string_agg(v || '=' || n, ',' order by v || '=' || n) as levels from
          (select file, coalesce(log_level, 'unknown') as v, count(*) as n from dirty group by all) group by 1) using (file)""", _ALL, _REPORT),
    "export_info": _dirty("""select file, count(*) as record_count, true as has_metadata, '2024-02-01T00:00:00Z' as created_at, count(*) as total_records,
        'json' as format from dirty group by 1"""),
    "export_catalog": _dirty("select file, 1 as files, 64 as digest_length from dirty group by 1"),
    "storage_stats": _dirty("""select area, 1 as rows, (select count(distinct file) > 1 from dirty) as many from (values ('exports'), ('total')) as t(area)"""),
    "training_suitability": with_logs("""select count(*) as total_records, count(*) filter (where process_name in ('hostapd', 'wpa_supplicant')) as wifi_logs,
        cast(floor((epoch_us(max(log_ts)) - epoch_us(min(log_ts))) / 86400e6) as bigint) as time_range_days,
        round(avg(case when process_name in ('hostapd', 'wpa_supplicant') then 1.0 else 0.0 end), 6) as wifi_ratio,
        avg(case when process_name in ('hostapd', 'wpa_supplicant') then 1.0 else 0.0 end) < 0.1 as low_wifi_ratio,
        epoch_us(max(log_ts)) - epoch_us(min(log_ts)) < 86400000000 as short_time_range from logs"""),
}
SQL["suitability_by_process"] = SQL["training_suitability"].replace(
    "select count(*) as total_records", "select process_name, count(*) as total_records") + " group by process_name"
