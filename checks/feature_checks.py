"""Per-record features, process lookups, trailing windows, filling and scaling."""

from pyspark.sql import functions as F

from checks.views import logs, with_logs
from logprism.functions import features as fx
from logprism.functions import fixed
from logprism.operators import scaling
from logprism.operators.process import process_features
from logprism.operators.windows import log_measures, rolling_count, rolling_distinct, trailing_windows
from logprism.plans.features import extract_features

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MAC = fixed.MAC


def _select(df, key, names, ratios=()):
    return df.select(key, *[
        F.round(F.col(n).cast("double"), 6).alias(n) if n in ratios else F.col(n).cast("long").alias(n)
        for n in names
    ])


def features_time(spark, sf_dir):
    df = logs(spark, sf_dir)
    return _select(df.withColumns(fx.time_features(F.col("log_ts"))), "record_id", fx.TIME_FEATURES)


def features_wifi(spark, sf_dir):
    df = logs(spark, sf_dir)
    return _select(df.withColumns(fx.wifi_features(F.col("message"))), "record_id", fx.WIFI_FEATURES)


def features_addresses(spark, sf_dir):
    df = logs(spark, sf_dir)
    m = F.col("message")
    return df.select("record_id", F.array_join(fx.mac_addresses(m), ",").alias("macs"),
                     F.array_join(fx.ip_addresses(m), ",").alias("ips"))


def features_text(spark, sf_dir):
    df = logs(spark, sf_dir)
    return _select(df.withColumns(fx.text_features(F.col("message"))), "record_id",
                   fx.TEXT_FEATURES, ("uppercase_ratio",))


def features_text_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _select(df.withColumns(fx.text_features(F.col("text"))), "doc_id",
                   fx.TEXT_FEATURES, ("uppercase_ratio",))


def features_process(spark, sf_dir):
    df = process_features(logs(spark, sf_dir)).withColumn(
        "log_level_numeric", fx.level_number(F.col("log_level")))
    return _select(df, "record_id", fx.PROCESS_FEATURES, ("process_rank", "process_frequency"))


def features_all(spark, sf_dir):
    df = extract_features(logs(spark, sf_dir))
    sums = [F.sum(F.col(n).cast("double")).alias(n) for n in fx.FEATURE_NAMES]
    sums += [F.sum(f"{w}_{m}").cast("double").alias(f"{w}_{m}") for w in fixed.WINDOWS for m in log_measures()]
    out = df.groupBy("log_level").agg(F.count("*").alias("n"), *sums)
    return out.select("log_level", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


def _window(name):
    def query(spark, sf_dir):
        df = trailing_windows(logs(spark, sf_dir), "log_ts", log_measures(), {name: fixed.WINDOWS[name]})
        return df.select("record_id", *[f"{name}_{m}" for m in log_measures()])
    return query


def window_all(spark, sf_dir):
    from logprism.operators.windows import WINDOW_FEATURES, window_features

    return window_features(logs(spark, sf_dir)).select("record_id", *WINDOW_FEATURES)


def rolling_count_by_device(spark, sf_dir):
    df = rolling_count(logs(spark, sf_dir), "log_ts", F.col("log_level").isin("ERROR", "CRITICAL"),
                       1440, keys=["device_id"])
    return df.select("record_id", "rolling_count")


def rolling_distinct_by_device(spark, sf_dir):
    df = rolling_distinct(logs(spark, sf_dir), "log_ts", "process_name", 2880, keys=["device_id"])
    return df.select("record_id", "rolling_distinct")


def rolling_count_by_process(spark, sf_dir):
    df = rolling_count(logs(spark, sf_dir), "log_ts", F.lit(True), 60, keys=["process_name"])
    return df.select("record_id", "rolling_count")


_FILLED = ("process_rank", "process_frequency", "uppercase_ratio", "message_length")


def _sparse_features(spark, sf_dir):
    df = process_features(logs(spark, sf_dir))
    m = F.col("message")
    return df.withColumns({"uppercase_ratio": fx.text_features(m)["uppercase_ratio"],
                           "message_length": F.when(m != "", F.length(m))})


def impute_median(spark, sf_dir):
    df = scaling.impute_median(_sparse_features(spark, sf_dir), _FILLED)
    return df.select("record_id", *[F.round(c, 6).alias(c) for c in _FILLED])


def impute_mode(spark, sf_dir):
    df = scaling.impute_mode(logs(spark, sf_dir), ["process_name", "log_level"])
    return df.select("record_id", "process_name", "log_level")


def standardise(spark, sf_dir):
    df = _sparse_features(spark, sf_dir).withColumn("constant", F.lit(3.0))
    names = [*_FILLED, "constant"]
    scaler = scaling.Scaler.fit(df, names)
    out = scaler.transform(scaler.fill(df))
    return out.select("record_id", *[F.round(c, 6).alias(c) for c in names])


def feature_vector(spark, sf_dir):
    df = scaling.feature_vector(_sparse_features(spark, sf_dir), [*_FILLED, "not_there"])
    parts = {f"f{i}": F.round(F.col("features")[i], 6) for i in range(5)}
    return df.select("record_id", *[c.alias(n) for n, c in parts.items()])


QUERIES = {
    "features_time": features_time,
    "features_wifi": features_wifi,
    "features_addresses": features_addresses,
    "features_text": features_text,
    "features_text_documents": features_text_documents,
    "features_process": features_process,
    "features_all": features_all,
    **{name: _window(name) for name in fixed.WINDOWS},
    "window_all": window_all,
    "rolling_count_by_device": rolling_count_by_device,
    "rolling_distinct_by_device": rolling_distinct_by_device,
    "rolling_count_by_process": rolling_count_by_process,
    "impute_median": impute_median,
    "impute_mode": impute_mode,
    "standardise": standardise,
    "feature_vector": feature_vector,
}

# --- SQL --------------------------------------------------------------------

_TIME = """
hour(log_ts) as hour_of_day, isodow(log_ts) - 1 as day_of_week, minute(log_ts) as minute_of_hour,
hour(log_ts) * 3600 + minute(log_ts) * 60 + second(log_ts) as time_since_midnight,
case when isodow(log_ts) >= 6 then 1 else 0 end as is_weekend,
case when hour(log_ts) >= 9 and hour(log_ts) < 17 then 1 else 0 end as is_business_hours"""
_WIFI = rf"""
case when regexp_matches(message, '{fixed.CONNECTION_EVENT}', 'i') then 1 else 0 end as is_connection_event,
case when regexp_matches(message, '{fixed.AUTH_EVENT}', 'i') then 1 else 0 end as is_auth_event,
case when regexp_matches(message, '{fixed.ERROR_EVENT}', 'i') then 1 else 0 end as is_error_event,
len(regexp_extract_all(message, '{MAC}')) as mac_count,
len(regexp_extract_all(message, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b')) as ip_count,
length(message) as message_length"""
_TEXT = rf"""
len(regexp_extract_all(message, '[^{SPACE}]+')) as word_count,
len(regexp_extract_all(message, '[^a-zA-Z0-9{SPACE}]')) as special_char_count,
len(regexp_extract_all(message, '[A-Z]')) / greatest(length(message), 1) as uppercase_ratio,
len(regexp_extract_all(message, '\p{{Nd}}')) as number_count,
case when message = '' then 0 else len(list_distinct(string_split(message, ''))) end as unique_chars"""
_LEVEL = """case log_level when 'DEBUG' then 0 when 'INFO' then 1 when 'WARNING' then 2
 when 'ERROR' then 3 when 'CRITICAL' then 4 else 1 end as log_level_numeric"""
_PROCESS = """
proc as (select process_name, dense_rank() over (order by n) as process_rank, n / sum(n) over () as process_frequency
  from (select process_name, count(*) as n from logs where process_name is not null group by 1))"""


def _windows(names, source="logs"):
    parts = []
    for name in names:
        over = f"over (order by log_ts range between interval {fixed.WINDOWS[name]} minutes preceding and current row)"
        parts.append(f"""
cast(sum(case when regexp_matches(message, 'AP-STA-CONNECTED', 'i') then 1 else 0 end) {over} as bigint) as {name}_connection_count,
cast(len(list_distinct(flatten(list(regexp_extract_all(message, '{MAC}')) {over}))) as bigint) as {name}_unique_macs,
cast(sum(case when regexp_matches(message, 'ERROR|FAILED', 'i') then 1 else 0 end) {over} as bigint) as {name}_error_count,
count(distinct process_name) {over} as {name}_process_diversity""")
    return ",".join(parts)


_LONG = [n for n in fx.TIME_FEATURES + fx.WIFI_FEATURES + fx.TEXT_FEATURES if n != "uppercase_ratio"]
_ALL_WINDOWS = [f"{w}_{m}" for w in fixed.WINDOWS
                for m in ("connection_count", "unique_macs", "error_count", "process_diversity")]


def _cast(names, ratios=()):
    return ", ".join(f"round(cast({n} as double), 6) as {n}" if n in ratios else f"cast({n} as bigint) as {n}"
                     for n in names)


_SPARSE = f"""{_PROCESS}, sparse as (select record_id, process_rank, process_frequency,
  len(regexp_extract_all(message, '[A-Z]')) / greatest(length(message), 1) as uppercase_ratio,
  case when message <> '' then length(message) end as message_length
  from logs left join proc using (process_name))"""
_MEDIANS = "med as (select " + ", ".join(f"median(cast({n} as double)) as {n}" for n in _FILLED) + " from sparse)"
_FILL = "filled as (select record_id, " + ", ".join(
    f"coalesce(cast(s.{n} as double), med.{n}) as {n}" for n in _FILLED) + " from sparse s, med)"

SQL = {
    "features_time": with_logs(f"select record_id, {_cast(fx.TIME_FEATURES)} from (select record_id, {_TIME} from logs)"),
    "features_wifi": with_logs(f"select record_id, {_cast(fx.WIFI_FEATURES)} from (select record_id, {_WIFI} from logs)"),
    "features_addresses": with_logs(rf"""select record_id,
        array_to_string(regexp_extract_all(message, '{MAC}'), ',') as macs,
        array_to_string(regexp_extract_all(message, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b'), ',') as ips from logs"""),
    "features_text": with_logs(
        f"select record_id, {_cast(fx.TEXT_FEATURES, ('uppercase_ratio',))} from (select record_id, {_TEXT} from logs)"),
    "features_text_documents":
        f"select doc_id, {_cast(fx.TEXT_FEATURES, ('uppercase_ratio',))} from "
        f"(select doc_id, {_TEXT} from (select doc_id, text as message from documents))",
    "features_process": with_logs(
        f"select record_id, {_cast(fx.PROCESS_FEATURES, ('process_rank', 'process_frequency'))} from "
        f"(select *, {_LEVEL} from logs left join proc using (process_name))", _PROCESS),
    "features_all": with_logs(
        "select log_level, count(*) as n, "
        + ", ".join(f"round(cast(sum({n}) as double), 4) as {n}" for n in [*fx.FEATURE_NAMES, *_ALL_WINDOWS])
        + f" from (select log_level, {_TIME}, {_WIFI}, {_TEXT}, process_rank, {_LEVEL}, process_frequency,"
        f" {_windows(fixed.WINDOWS)} from logs left join proc using (process_name)) group by 1", _PROCESS),
    **{name: with_logs(f"select record_id, {_windows([name])} from logs") for name in fixed.WINDOWS},
    "window_all": with_logs(f"select record_id, {_windows(fixed.WINDOWS)} from logs"),
    "rolling_count_by_device": with_logs("""select record_id, cast(sum(case when log_level in ('ERROR', 'CRITICAL') then 1 else 0 end)
        over (partition by device_id order by log_ts range between interval 1440 minutes preceding and current row) as bigint) as rolling_count from logs"""),
    "rolling_distinct_by_device": with_logs("""select record_id, count(distinct process_name)
        over (partition by device_id order by log_ts range between interval 2880 minutes preceding and current row) as rolling_distinct from logs"""),
    "rolling_count_by_process": with_logs("""select record_id, count(*)
        over (partition by process_name order by log_ts range between interval 60 minutes preceding and current row) as rolling_count from logs"""),
    "impute_median": with_logs("select record_id, " + ", ".join(f"round({n}, 6) as {n}" for n in _FILLED)
                               + " from filled", f"{_SPARSE}, {_MEDIANS}, {_FILL}"),
    "impute_mode": with_logs("""select record_id,
        coalesce(process_name, (select process_name from logs where process_name is not null group by 1 order by count(*) desc, 1 limit 1), 'unknown') as process_name,
        coalesce(log_level, (select log_level from logs where log_level is not null group by 1 order by count(*) desc, 1 limit 1), 'unknown') as log_level
        from logs"""),
    "standardise": with_logs("select record_id, " + ", ".join(
        f"round(({n} - avg({n}) over ()) / (stddev_pop({n}) over ()), 6) as {n}" for n in _FILLED)
        + ", 0.0::double as constant from filled", f"{_SPARSE}, {_MEDIANS}, {_FILL}"),
    "feature_vector": with_logs("select record_id, " + ", ".join(
        f"round(coalesce(cast({n} as double), 0), 6) as f{i}" for i, n in enumerate(_FILLED))
        + ", 0.0::double as f4 from sparse", _SPARSE),
}
