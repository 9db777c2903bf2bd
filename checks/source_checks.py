"""Broken documents, split documents, tails, stored findings, link sessions, stateful streams, logs scored end to end."""

from functools import reduce

from pyspark.sql import functions as F

from checks.model_checks import FIXED_NODES, _PREDICTED, _finished, _log_stream, _path, _predicted
from checks.quality_checks import SQL as QUALITY_SQL
from checks.quality_checks import _exported, _named
from checks.summary_checks import _KIND, _num
from checks.views import SERVICE, logs, service, with_logs, with_scored, with_view
from logprism.functions import fixed
from logprism.functions.features import mac_addresses
from logprism.operators import evaluate as ev
from logprism.operators import forest as forest_ops
from logprism.operators import quality, rollups
from logprism.operators import sessions as links
from logprism.operators.scaling import Scaler
from logprism.operators.windows import WINDOW_FEATURES
from logprism.plans import scoring
from logprism.plans.features import extract_features
from logprism.session import run_dir, store
from logprism.sources import exports, files, model_store, split_exports
from logprism.sources import logs as log_source
from logprism.streaming import stateful, streams


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- documents with planted faults: one for each 50 events ---------------------------

#: Fault of document k is entry k % len: the body's text (meta, data and body of the sound one), and its rules.
FAULTS = (
    ("body", ()),
    ("substring(body, 1, length(body) - 20)", ("invalid_json",)),
    ("concat('[', body, ']')", ("invalid_json",)),
    ("concat('{\"export_metadata\":', meta, '}')", ("missing_data",)),
    ("concat('{\"data\":', data, '}')", ("missing_export_metadata",)),
    ("'{}'", ("missing_data", "missing_export_metadata")),
    ("concat('{\"export_metadata\":7,\"data\":', data, '}')", ("export_metadata_not_object",)),
    ("concat('{\"export_metadata\":', meta, ',\"data\":{\"n\":1}}')", ("data_not_array",)),
    ("concat('{\"export_metadata\":[1],\"data\":null}')", ("export_metadata_not_object", "data_not_array")),
    ("concat('{\"export_metadata\":', meta, ',\"data\":[]}')", ("empty_data",)),
    ("concat('{\"export_metadata\":{},\"data\":', data, '}')",
     ("missing_metadata_created_at", "missing_metadata_total_records", "missing_metadata_format")),
    ("concat('{\"export_metadata\":{\"created_at\":\"soon\",\"total_records\":\"5\",\"format\":\"csv\"},\"data\":', data, '}')",
     ("invalid_created_at", "invalid_total_records", "unsupported_format")),
    ("concat('{\"export_metadata\":{\"created_at\":\"2024-02-01\",\"total_records\":-1,\"format\":\"json\"},\"data\":', data, '}')",
     ("invalid_total_records",)),
    ("concat('{\"export_metadata\":{\"created_at\":null,\"total_records\":1.5,\"format\":null},\"data\":', data, '}')",
     ("invalid_created_at", "invalid_total_records", "unsupported_format")),
)


def _faulty(spark, sf_dir):
    """Folder of documents, most of them broken, each a file doc=<number>.json; a thousand share a folder."""
    rows = logs(spark, sf_dir).select(
        F.floor(F.col("record_id") / 50).alias("doc"), "record_id",
        F.struct(F.date_format("log_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "message",
                 F.coalesce("process_name", F.lit("p")).alias("process_name"), F.lit("INFO").alias("log_level")).alias("r"))
    docs = rows.groupBy("doc").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("record_id", "r"))), lambda x: x["r"])).alias("data"))
    docs = docs.withColumn("meta", F.lit('{"created_at":"2024-02-01T00:00:00Z","total_records":50,"format":"json"}'))
    docs = docs.withColumn("body", F.expr("concat('{\"export_metadata\":', meta, ',\"data\":', data, '}')"))
    name = F.expr("concat('part=', doc div 1000, '/doc=', doc, '.json')")
    value = F.expr("case " + " ".join(f"when doc % {len(FAULTS)} = {k} then {text}" for k, (text, _) in enumerate(FAULTS)) + " end")
    path = run_dir(spark, "faulty")
    exports.write_documents(docs.select(name.alias("name"), F.concat(value, F.lit("\n")).alias("body")), path)
    return path


def _numbered(df):
    return df.withColumn("doc", F.regexp_extract("file", "doc=([0-9]+)", 1).cast("long"))


def broken_exports(spark, sf_dir):
    found = quality.document_violations(exports.read_documents(spark, _faulty(spark, sf_dir)))
    return _numbered(found).select("doc", "rule")


def broken_exports_report(spark, sf_dir):
    """Whether each document is valid, by all rules of structure; sound documents have sound records."""
    docs = exports.read_documents(spark, _faulty(spark, sf_dir))
    return _numbered(quality.validation_report(docs, quality.document_violations(docs))).select("doc", "is_valid", "error_count")


_RULES = " ".join(f"when {k} then [{', '.join(repr(r) for r in rules)}]" for k, (_, rules) in enumerate(FAULTS) if rules)
_BROKEN = (f"select doc, unnest(rules) as rule from (select distinct event_id // 50 as doc, case (event_id // 50) % {len(FAULTS)} {_RULES} "
           "else [] end as rules from events)")


# --- findings, registry --------------------------------------------------------------------

def storage_findings(spark, sf_dir):
    """Model folders of the regions, each lacking what its number says; broken documents; one empty log."""
    root, log_path = run_dir(spark, "models"), run_dir(spark, "logs")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(
        F.col("r_regionkey").alias("k"), F.concat(F.lit("v"), F.col("r_regionkey")).alias("version"))
    regions = store(regions, "regions")
    for k, part in enumerate(files.REQUIRED_PARTS, 1):
        # region 0 has all parts, region k lacks part k, and those from 4 on have none
        for row in regions.filter((F.col("k") < 4) & (F.col("k") != k)).collect():
            spark.range(1).select(F.lit("x").alias("value")).coalesce(1).write.text(f"{root}/{row.version}/{part}")
    empty = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{log_path}/empty/service.log")  # Spark writes no empty text file
    empty.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(empty).close()
    spark.range(1).select(F.lit("x").alias("value")).coalesce(1).write.text(f"{log_path}/full")
    found = files.storage_findings(spark, root, _faulty(spark, sf_dir), log_path, regions.select("version"))
    place = F.when(F.col("area") == "exports", F.regexp_extract("item", "doc=([0-9]+)", 1)).when(
        F.col("area") == "logs", F.regexp_extract("item", "/(empty|full)/", 1)).otherwise(F.col("item"))
    return found.select("area", place.alias("item"), "finding")


def registry_entries(spark, sf_dir):
    """Two saved models, whose metrics are sums over the logs, read back from the appended registry."""
    root = run_dir(spark, "models")
    rows = logs(spark, sf_dir).select("record_id", F.col("metric").cast("double"))
    scaler = Scaler.fit(rows, ("metric",))
    nodes = spark.createDataFrame([(0, 0, -1, 0.0, 0, 0, 8, 0)], forest_ops.NODE_SCHEMA)
    totals = rows.agg(F.count("*").cast("double").alias("rows"), F.avg("metric").alias("mean")).first()
    for version, passed in (("v1", 3), ("v2", 1)):
        metadata = model_store.build_metadata(
            version, "2024-02-01T00:00:00", "isolation_forest", int(totals["rows"]), ("metric",), {},
            {"rows": totals["rows"], "mean": totals["mean"], "absent": None}, {}, (passed, 4))
        model_store.save_model(spark, model_store.Model(version, scaler, nodes, -0.5, metadata), root)
    entries = model_store.read_registry_entries(spark, root)
    return entries.select(
        "version", F.element_at(F.split("path", "/"), -1).alias("folder"), "created_at", "status", "passed_thresholds", "total_thresholds",
        F.round(F.col("metrics")["rows"], 6).alias("metric_rows"), F.round(F.col("metrics")["mean"], 6).alias("metric_mean"),
        F.size("metrics").alias("metrics"))


def pseudo_labels(spark, sf_dir):
    """Without labels the predictions stand in: label, and how many of each an evaluation counts."""
    rows = _predicted(spark, sf_dir).select(
        "record_id", F.col("anomaly_score").alias("score"), ev.from_signed_labels(F.col("prediction")).cast("int").alias("label"))
    counted = rows.groupBy("label").agg(F.count("*").alias("n"))
    return rows.join(counted, "label").select("record_id", "label", "n")


# --- a log file scored end to end -------------------------------------------------------------

LOG_FEATURES = ("message_length", "mac_count", "hour_of_day")


def log_file_scores(spark, sf_dir):
    """JSON-line logs read, turned into features, scaled, scored by a fixed forest, and summed up."""
    path = run_dir(spark, "log-file")
    stamped = logs(spark, sf_dir).select(
        F.col("record_id").cast("string").alias("id"), F.date_format("log_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "message", "process_name", "log_level")
    stamped.write.json(path)
    rows = log_source.read_logs(spark, path, "json").select("id", "log_ts", "message", "process_name", "log_level")
    features = store(extract_features(rows, keep=["id"], windows=False).select(
        "id", *[F.col(c).cast("double").alias(c) for c in LOG_FEATURES]), "features")
    # the nodes of the fixed forest, over these three columns
    nodes = spark.createDataFrame(list(FIXED_NODES), forest_ops.NODE_SCHEMA)
    model = model_store.Model("fixed", Scaler.fit(features, LOG_FEATURES), nodes, -0.5)
    return _rounded(scoring.prediction_summary(scoring.score_logs(rows, model, windows=False)))


_LOG_FILE = with_logs(f"""select 0.5 - score as decision, case when 0.5 - score < 0 then -1 else 1 end as prediction from (select power(2.0, -(
      case when m <= 0 then 1 + {_path(3)} when h <= 0.5 then 2 + {_path(4)} else 2 + {_path(1)} end
      + case when d <= -0.25 then 1 + {_path(2)} else 1 + {_path(6)} end) / (2 * {_path(8)})) as score from z)""",
    f"""z as (select (m - avg(m) over ()) / stddev_pop(m) over () as m, (d - avg(d) over ()) / stddev_pop(d) over () as d,
      (h - avg(h) over ()) / stddev_pop(h) over () as h from (select cast(length(message) as double) as m,
        cast(len(regexp_extract_all(message, '{fixed.MAC}')) as double) as d, cast(hour(log_ts) as double) as h from logs))""")


# --- split documents, tails ------------------------------------------------------------------

def split_export_records(spark, sf_dir):
    """The documents of ``export_records``, read by byte ranges."""
    rows = split_exports.read_split_export(spark, _exported(spark, sf_dir))
    return _named(rows).select("file", "record_idx", "process_name", "log_level", "message", F.unix_micros("log_ts").alias("micros"))


def split_export_one_document(spark, sf_dir):
    """All logs as one document, read in many tasks."""
    path = run_dir(spark, "one-document")
    exports.write_export(logs(spark, sf_dir).select(
        F.lit("all").alias("file"), "record_id", F.date_format("log_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "message",
        "process_name", "log_level"), path, "file", "record_id", "2024-02-01T00:00:00Z")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        rows = split_exports.read_split_export(spark, path)
        tasks = rows.rdd.getNumPartitions()
        return store(rows.select("record_idx", "message", F.unix_micros("log_ts").alias("micros"), F.lit(tasks > 1).alias("many_tasks")), "records")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def split_export_completeness(spark, sf_dir):
    """Which of the documents with planted faults have records, how many, and which break off."""
    ranges, _ = split_exports.export_ranges(spark, _faulty(spark, sf_dir))
    return _numbered(split_exports.export_completeness(ranges)).select("doc", "has_data", "records", "is_complete")


def service_tail(spark, sf_dir):
    """Of files of 300 lines, some blank or broken, the rows of the last 40 lines of each."""
    path = run_dir(spark, "tails")
    line = F.to_json(F.struct(F.date_format("log_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "level", "logger", "message", "line"))
    key = F.col("line")
    text = F.when(key % 41 == 7, F.lit("no json {")).when(key % 43 == 11, F.lit("  ")).otherwise(line)
    rows = service(spark, sf_dir).select(F.floor(key / 300).alias("part"), "line", text.alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "line").drop("line").write.partitionBy("part").text(path)
    tail = log_source.read_service_tail(spark, path, 40)
    return tail.select(F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "from_end", "line", "level")


# --- link sessions --------------------------------------------------------------------------

def _sessions(spark, sf_dir):
    return store(links.sessions(logs(spark, sf_dir)), "sessions")


def link_sessions(spark, sf_dir):
    return links.sessions(logs(spark, sf_dir)).drop("log_end_us")


def link_stability(spark, sf_dir):
    return _rounded(links.connection_stability(_sessions(spark, sf_dir)))


def network_load(spark, sf_dir):
    return _rounded(links.network_load(_sessions(spark, sf_dir)))


def signal_trend(spark, sf_dir):
    return _rounded(links.signal_trend(logs(spark, sf_dir)))


def link_features(spark, sf_dir):
    return _rounded(links.link_features(logs(spark, sf_dir)).select(
        "device", "device_type", "connection_type", "sessions", "connection_stability", "signal_strength_trend"))


_SESSIONS = f"""ev as (select device_id as device, epoch_us(log_ts) as t, bool_or(regexp_matches(coalesce(message, ''), '{fixed.CONNECTED}', 'i')) as on_,
      bool_or(regexp_matches(coalesce(message, ''), '{links.DISCONNECT}', 'i')) as off_ from logs
      where device_id is not null and log_ts is not null and regexp_matches(coalesce(message, ''), '{fixed.CONNECTED}|{links.DISCONNECT}', 'i') group by all),
    nx as (select *, lead(t) over w as t2, lead(off_) over w as off2 from ev window w as (partition by device order by t)),
    ends as (select epoch_us(max(log_ts)) as last from logs),
    sess as (select device, t as start_us, coalesce(t2, last) as end_us,
      case when t2 is null then 'open' when off2 then 'disconnect' else 'reconnect' end as ended_by from nx, ends where on_)"""
_STABLE = """stable as (select device, count(*) as sessions, count(*) filter (where ended_by = 'disconnect') as drops,
    sum(end_us - start_us) / 1e6 as connected_seconds, (any_value(last) - min(start_us)) / 1e6 as observed_seconds,
    sum(end_us - start_us) / nullif(any_value(last) - min(start_us), 0) as connection_stability from sess, ends group by device)"""
_TREND = f"""trend as (select device_id as device, count(*) as readings, regr_slope(y, x) as signal_strength_trend from (
    select device_id, epoch_us(log_ts) / 3.6e9 as x, try_cast(regexp_extract(message, '{fixed.SIGNAL}', 1, 'i') as double) as y from logs)
    where device_id is not null and x is not null and y is not null group by 1)"""
_KINDS = f"""named as (select device_id as device, case when mac = '' then null when (cast('0x' || mac[1:2] as int) & 2) = 2 then 'private' else 'vendor' end as dt,
      case when ch between 1 and 14 then '2.4GHz' when ch between 32 and 177 then '5GHz' end as ct from (select device_id,
        coalesce(regexp_extract(message, '{fixed.MAC}'), '') as mac, try_cast(regexp_extract(message, '{fixed.CHANNEL}', 1, 'i') as int) as ch from logs)
      where device_id is not null),
    kinds as (select d.device, x.dt as device_type, y.ct as connection_type from (select distinct device from named) d
      left join (select device, dt from (select device, dt, count(*) as n from named where dt is not null group by all)
        qualify row_number() over (partition by device order by n desc, dt) = 1) x using (device)
      left join (select device, ct from (select device, ct, count(*) as n from named where ct is not null group by all)
        qualify row_number() over (partition by device order by n desc, ct) = 1) y using (device))"""
_LOAD = """steps as (select t, sum(d) as d from (select start_us as t, 1 as d from sess union all select end_us, -1 from sess
      union all select h * 3600000000, 0 from (select unnest(range(min(start_us) // 3600000000 + 1, (max(end_us) - 1) // 3600000000 + 1)) as h from sess)) group by t),
    lev as (select t, sum(d) over (order by t) as l, lead(t) over (order by t) - t as dt from steps)"""


# --- roll-ups ---------------------------------------------------------------------------------

def _rollup(spark, sf_dir, keys=()):
    """A roll-up by hour, stored by day and read back."""
    path = run_dir(spark, "rollup")
    rollups.write_rollup(rollups.hourly_rollup(logs(spark, sf_dir), keys, metric="metric"), path)
    return spark.read.parquet(path)


def rollup_by_process(spark, sf_dir):
    """A span of days merged per process: all that merges exactly."""
    some = rollups.span(_rollup(spark, sf_dir, ["process_name"]), "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return _rounded(rollups.rollup_summary(some, ["process_name"]).select(
        "process_name", "rows", "errors", "warnings", "auth_failure_rows", "deauth_rows", "beacon_rows", "association_rows",
        "disassociation_rows", "mean_signal", "std_signal", "mean_rate", "mean_loss", "mean_length", "first_us", "last_us"))


def rollup_codes(spark, sf_dir):
    """Codes of all logs from the merged sketches; fewer occur than the sketches hold, so counts are exact."""
    found = rollups.rollup_summary(_rollup(spark, sf_dir), top=rollups.TRACKED)
    return found.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(k) for k in rollups.CODES]), F.array(*[F.col(f"{k}_codes") for k in rollups.CODES]))).alias("kind", "_c")).select(
        "kind", F.inline("_c"))


def rollup_estimates(spark, sf_dir):
    """Distinct counts within 5 % and quantiles within a rank of 3 %, against the exact ones beside them."""
    found = rollups.rollup_summary(_rollup(spark, sf_dir))
    rows = logs(spark, sf_dir).filter("log_ts is not null").select(
        F.col("device_id").cast("string").alias("device"), F.length(F.coalesce("message", F.lit(""))).alias("length"), "metric",
        F.transform(mac_addresses(F.coalesce("message", F.lit(""))), F.lower).alias("macs"))
    exact = rows.agg(F.count_distinct("device").alias("devices_exact")).join(
        rows.select(F.explode("macs").alias("m")).agg(F.count_distinct("m").alias("macs_exact")))
    parts = []
    for column in ("length", "metric"):
        for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            cut = found.select(F.col(f"{column}_{name}").cast("double")).scalar()
            below, upto = F.avg((F.col(column) < cut).cast("double")), F.avg((F.col(column) <= cut).cast("double"))
            parts.append(rows.agg(((below <= q + 0.03) & (upto >= q - 0.03)).alias("within")).select(F.lit(f"{column}_{name}").alias("value"), "within"))
    for name in ("devices", "macs"):
        parts.append(found.select(name).join(exact).select(
            F.lit(name).alias("value"), (F.abs(F.col(name) - F.col(f"{name}_exact")) <= 0.05 * F.col(f"{name}_exact")).alias("within")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- stateful streams -------------------------------------------------------------------------

def stream_windows(spark, sf_dir):
    """Trailing windows per device, of all records that the watermark has passed, from keyed state."""
    stream = _log_stream(spark, sf_dir).select("record_id", "device_id", "log_ts", "message", "process_name", "log_level")
    return _finished(spark, stateful.stream_window_features(stream, keys=["device_id"])).select("record_id", *WINDOW_FEATURES)


def stream_sessions(spark, sf_dir):
    out = _finished(spark, streams.stream_sessions(_log_stream(spark, sf_dir), "3 minutes"))
    return out.select(F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "process_name",
                      "events", "errors", "connections")


def stream_first_records(spark, sf_dir):
    """Kept records per process, of records that agree in device, process and message."""
    rows = _finished(spark, streams.stream_first_records(_log_stream(spark, sf_dir), ("device_id", "process_name", "message")))
    return rows.groupBy("process_name").agg(F.count("*").alias("n"), F.count_distinct("device_id", F.coalesce("message", F.lit(""))).alias("keys"))


def _stream_windows_sql():
    widths = {w: m * 60_000_000 for w, m in fixed.WINDOWS.items()}

    def over(us):
        return f"(partition by device_id order by epoch_us(log_ts) range between {us} preceding and current row)"

    counts = ", ".join(
        f"count(*) filter (where regexp_matches(message, '{fixed.CONNECTED}', 'i')) over {over(us)} as {w}_connection_count, "
        f"count(*) filter (where regexp_matches(message, '{fixed.FAILURE}', 'i')) over {over(us)} as {w}_error_count, "
        f"len(list_distinct(flatten(list(regexp_extract_all(coalesce(message, ''), '{fixed.MAC}')) over {over(us)}))) as {w}_unique_macs, "
        f"len(list_distinct(list(process_name) over {over(us)})) as {w}_process_diversity" for w, us in widths.items())
    return with_logs(f"select record_id, {', '.join(WINDOW_FEATURES)} from (select *, {counts} from logs) "
                     "where log_ts <= (select date_trunc('milliseconds', max(log_ts)) - interval '10 minutes' from logs)")


QUERIES = {
    "broken_exports": broken_exports,
    "broken_exports_report": broken_exports_report,
    "storage_findings": storage_findings,
    "registry_entries": registry_entries,
    "pseudo_labels": pseudo_labels,
    "log_file_scores": log_file_scores,
    "split_export_records": split_export_records,
    "split_export_one_document": split_export_one_document,
    "split_export_completeness": split_export_completeness,
    "service_tail": service_tail,
    "link_sessions": link_sessions,
    "link_stability": link_stability,
    "network_load": network_load,
    "signal_trend": signal_trend,
    "link_features": link_features,
    "stream_windows": stream_windows,
    "stream_sessions": stream_sessions,
    "stream_first_records": stream_first_records,
    "rollup_by_process": rollup_by_process,
    "rollup_codes": rollup_codes,
    "rollup_estimates": rollup_estimates,
}

_DOCS = f"docs as (select event_id // 50 as doc, (event_id // 50) % {len(FAULTS)} as k, count(*) as n from events group by all)"

SQL = {
    "broken_exports": _BROKEN,
    "broken_exports_report": f"""select d.doc, count(rule) = 0 as is_valid, count(rule) as error_count from (select distinct event_id // 50 as doc from events) d
        left join ({_BROKEN}) using (doc) group by 1""",
    "storage_findings": f"""select 'models' as area, 'v' || r_regionkey as item, case r_regionkey {" ".join(
        f"when {k} then 'missing_{p}'" for k, p in enumerate(files.REQUIRED_PARTS, 1))} else 'empty_model' end as finding from region where r_regionkey > 0
        union all select 'exports', cast(doc as varchar), 'invalid_json' from ({_BROKEN}) where rule = 'invalid_json'
        union all select 'logs', 'empty', 'empty_log'""",
    "registry_entries": """select version, version as folder, '2024-02-01T00:00:00' as created_at, 'available' as status, passed as passed_thresholds,
        4 as total_thresholds, cast(count(*) as double) as metric_rows, round(avg(value), 6) as metric_mean, 2 as metrics
        from events, (values ('v1', 3), ('v2', 1)) as m(version, passed) group by all""",
    "pseudo_labels": with_scored("""select record_id, cast(prediction = -1 as int) as label, count(*) over (partition by prediction) as n from predicted""", _PREDICTED),
    "log_file_scores": f"""select count(*) as total_samples, count(*) filter (where prediction = 1) as normal_count,
        count(*) filter (where prediction = -1) as anomaly_count, round(avg(cast(prediction = -1 as int)), 6) as anomaly_rate,
        round(avg(decision), 6) as mean_decision, round(stddev_pop(decision), 6) as std_decision from ({_LOG_FILE})""",
    "split_export_records": QUALITY_SQL["export_records"],
    "split_export_one_document": with_logs("""select row_number() over (order by record_id) - 1 as record_idx, message, epoch_us(log_ts) as micros,
        (select count(*) from events) > 900 as many_tasks from logs"""),
    "split_export_completeness": f"""with {_DOCS} select doc, k not in (2, 3, 5, 7, 8) as has_data, case when k in (2, 3, 5, 7, 8, 9) then 0 when k = 1 then n - 1 else n end as records,
        k <> 1 as is_complete from docs""",
    "service_tail": with_view("svc", SERVICE, """select line // 300 as part, from_end, line, level from (
        select *, row_number() over (partition by line // 300 order by line desc) as from_end from svc)
        where from_end <= 40 and line % 41 <> 7 and line % 43 <> 11"""),
    "link_sessions": with_logs("select * from sess", _SESSIONS),
    "link_stability": with_logs("""select device, sessions, drops, round(connected_seconds, 6) as connected_seconds,
        round(observed_seconds, 6) as observed_seconds, round(connection_stability, 6) as connection_stability from stable""", _SESSIONS, _STABLE),
    "network_load": with_logs("""select t // 3600000000 * 3600000000 as hour_us, round(coalesce(sum(l * dt) / sum(dt), 0), 6) as mean_load,
        cast(max(l) as bigint) as peak_load from lev group by 1""", _SESSIONS, _LOAD),
    "signal_trend": with_logs("select device, readings, round(signal_strength_trend, 6) as signal_strength_trend from trend", _TREND),
    "link_features": with_logs("""select device, device_type, connection_type, sessions, round(connection_stability, 6) as connection_stability,
        round(signal_strength_trend, 6) as signal_strength_trend from kinds left join stable using (device) left join trend using (device)""",
        _SESSIONS, _STABLE, _TREND, _KINDS),
    "stream_windows": _stream_windows_sql(),
    "stream_sessions": with_logs(f"""select min(t) as start_us, max(t) + 180000000 as end_us, process_name, count(*) as events,
        count(*) filter (where regexp_matches(message, '{fixed.FAILURE}', 'i')) as errors,
        count(*) filter (where regexp_matches(message, '{fixed.CONNECTED}', 'i')) as connections
        from (select *, sum(begins) over (partition by process_name order by t) as run from (
          select *, epoch_us(log_ts) as t, coalesce(cast(epoch_us(log_ts) - lag(epoch_us(log_ts)) over (
            partition by process_name order by log_ts) >= 180000000 as int), 1) as begins from logs))
        group by process_name, run
        having max(t) + 180000000 <= (select epoch_ms(max(log_ts)) * 1000 - 600000000 from logs)"""),
    "stream_first_records": with_logs("""select process_name, count(*) as n, count(*) as keys from (
        select distinct device_id, process_name, message from logs) group by 1"""),
    "rollup_by_process": with_logs(f"""select process_name, count(*) as rows, count(*) filter (where log_level in ('ERROR', 'CRITICAL')) as errors,
        count(*) filter (where log_level = 'WARNING') as warnings, {", ".join(
            f"count(*) filter (where kind = '{k}') as {k}_rows" for k in rollups.KINDS)},
        round(avg(sig), 6) as mean_signal, round(stddev_pop(sig), 6) as std_signal, round(avg(rate), 6) as mean_rate, round(avg(loss), 6) as mean_loss,
        round(avg(length(coalesce(message, ''))), 6) as mean_length, epoch_us(min(log_ts)) as first_us, epoch_us(max(log_ts)) as last_us
        from (select *, {_KIND} as kind, {_num('signal=(-?[0-9]+)')} as sig, {_num('rate=([0-9]+)')} as rate, {_num('packet_loss=([0-9]+)')} as loss from logs)
        where log_ts >= timestamp '2024-01-05 00:00:00' and log_ts < timestamp '2024-01-20 12:00:00' group by process_name"""),
    "rollup_codes": with_logs(" union all ".join(
        f"select '{kind}' as kind, code, count(*) as n from (select nullif(regexp_extract(message, '{p}', 1, 'i'), '') as code from logs) where code is not null group by code"
        for kind, p in rollups.CODES.items())),
    "rollup_estimates": """select value, true as within from (select unnest(['devices', 'macs', 'length_p50', 'length_p90', 'length_p99',
        'metric_p50', 'metric_p90', 'metric_p99']) as value)""",
}
