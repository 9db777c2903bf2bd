"""Summary vectors per set of logs."""

from pyspark.sql import functions as F

from checks.views import logs, with_logs
from logprism.functions import fixed
from logprism.operators import summary


def _rounded(df):
    # the mean gap is a quotient of whole microseconds, so its sixth digit can be
    # an exact tie, which the engines round differently; both sides add 1e-9
    df = df.withColumn("mean_time_between_events", F.col("mean_time_between_events") + 1e-9)
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def summary_global(spark, sf_dir):
    return _rounded(summary.summary_features(logs(spark, sf_dir)))


def summary_by_device(spark, sf_dir):
    return _rounded(summary.summary_features(logs(spark, sf_dir), keys=["device_id"]))


def summary_by_hour(spark, sf_dir):
    df = logs(spark, sf_dir).withColumn("hour_key", F.floor(F.unix_micros(F.col("log_ts").cast("timestamp")) / 3.6e9))
    return _rounded(summary.summary_features(df, keys=["hour_key"]))


def summary_by_process(spark, sf_dir):
    return _rounded(summary.summary_features(logs(spark, sf_dir), keys=["process_name"]))


def code_top10(spark, sf_dir):
    return summary.code_counts(logs(spark, sf_dir), "reason")


def code_top3_by_process(spark, sf_dir):
    return summary.code_counts(logs(spark, sf_dir), "status", ["process_name"], top=3)


def channel_use(spark, sf_dir):
    return summary.code_counts(logs(spark, sf_dir), "channel", top=None)


def code_maps(spark, sf_dir):
    maps = summary.code_map(logs(spark, sf_dir), "status", ["process_name"], top=3)
    return maps.select("process_name", F.size("status_codes").alias("codes"),
                       F.aggregate(F.map_values("status_codes"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


QUERIES = {
    "summary_global": summary_global,
    "summary_by_device": summary_by_device,
    "summary_by_hour": summary_by_hour,
    "summary_by_process": summary_by_process,
    "code_top10": code_top10,
    "code_top3_by_process": code_top3_by_process,
    "code_maps": code_maps,
    "channel_use": channel_use,
    "program_counts": lambda s, d: summary.program_counts(logs(s, d)),
}

# --- SQL --------------------------------------------------------------------

_KIND = """case when regexp_matches(message, 'authentication failure|auth failed', 'i') then 'auth_failure'
 when regexp_matches(message, 'deauthentication|deauth', 'i') then 'deauth' when regexp_matches(message, 'beacon', 'i') then 'beacon'
 when regexp_matches(message, 'disassociation', 'i') then 'disassociation' when regexp_matches(message, 'association', 'i') then 'association' end"""


def _num(pattern):
    return f"try_cast(nullif(regexp_extract(message, '{pattern}', 1, 'i'), '') as bigint)"


_MACS = f"regexp_extract_all(lower(message), '{fixed.MAC}')"


def _summary(key=None, expression=None):
    k = expression or "0"
    sets = f"""sets as (select k, count(distinct m) as macs, count(distinct f) as fails from (select {k} as k, unnest({_MACS}) as m,
        unnest(case when {_KIND} = 'auth_failure' then {_MACS} else [] end) as f from logs) group by 1)"""
    dev = f"dev as (select {k} as k, device_id, count(*) as n from logs group by all)"
    act = "act as (select k, count(*) as d, max(n) as mx, avg(n) as av from dev group by 1)"
    core = f"""core as (select {k} as k, count(*) as n, sum(case when kind = 'auth_failure' then 1 else 0 end) as af, sum(case when kind = 'deauth' then 1 else 0 end) as de,
      sum(case when kind = 'beacon' then 1 else 0 end) as be, sum(case when kind = 'association' then 1 else 0 end) as aso, sum(case when kind = 'disassociation' then 1 else 0 end) as dis,
      count(distinct nullif(regexp_extract(message, 'SSID=''([^'']+)''', 1), '')) as ssids, avg(sig) as sm, stddev_pop(sig) as ss, avg(rate) as rm, avg(loss) as lm,
      avg(hour(log_ts)) as hm, avg(isodow(log_ts) - 1) as wm, (epoch_us(max(log_ts)) - epoch_us(min(log_ts))) / 1e6 as span,
      sum(case when log_level in ('ERROR', 'CRITICAL') then 1 else 0 end) as er, sum(case when log_level = 'WARNING' then 1 else 0 end) as wa
      from (select *, {_KIND} as kind, {_num('signal=(-?[0-9]+)')} as sig, {_num('rate=([0-9]+)')} as rate, {_num('packet_loss=([0-9]+)')} as loss from logs) group by 1)"""
    name = f"core.k as {key}, " if key else ""
    return with_logs(f"""select {name} round(af / d, 6) as auth_failure_ratio, round(de / d, 6) as deauth_ratio, round(be / d, 6) as beacon_ratio,
      coalesce(macs, 0) as unique_mac_count, ssids as unique_ssid_count, coalesce(fails, 0) as failed_auth_mac_count,
      round(coalesce(sm, 0), 6) as mean_signal_strength, round(coalesce(ss, 0), 6) as std_signal_strength, round(coalesce(rm, 0), 6) as mean_data_rate,
      round(coalesce(lm, 0), 6) as mean_packet_loss, round(hm, 6) as mean_hour_of_day, round(wm, 6) as mean_day_of_week,
      round(coalesce(span / nullif(core.n - 1, 0), 0) + 1e-9, 6) as mean_time_between_events, round(er / d, 6) as error_ratio, round(wa / d, 6) as warning_ratio,
      d as total_devices, mx as max_device_activity, round(av, 6) as mean_device_activity, cast(aso as bigint) as association_count, cast(dis as bigint) as disassociation_count
      from core join act on core.k is not distinct from act.k left join sets on core.k is not distinct from sets.k""", sets, dev, act, core)


def _codes(pattern, by=""):
    return f"""codes as (select {by} code, count(*) as n from
      (select process_name, regexp_extract(message, '{pattern}=([0-9]+)', 1) as code from logs) where code <> '' group by all)"""


_TOP3 = "top3 as (select * from (select *, row_number() over (partition by process_name order by n desc, code) as k from codes) where k <= 3)"

SQL = {
    "summary_global": _summary(),
    "summary_by_device": _summary("device_id", "device_id"),
    "summary_by_hour": _summary("hour_key", "cast(floor(epoch_us(log_ts) / 3.6e9) as bigint)"),
    "summary_by_process": _summary("process_name", "process_name"),
    "code_top10": with_logs("select code, n from codes order by n desc, code limit 10", _codes("reason")),
    "code_top3_by_process": with_logs("select process_name, code, n from top3", _codes("status", "process_name,"), _TOP3),
    "code_maps": with_logs("select process_name, count(*) as codes, cast(sum(n) as bigint) as n from top3 group by 1", _codes("status", "process_name,"), _TOP3),
    "channel_use": with_logs("select code, n from codes", _codes("channel")),
    "program_counts": with_logs("select coalesce(process_name, '') as process_name, count(*) as n from logs group by 1"),
}
