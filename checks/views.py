"""Log-shaped views over the given tables; the SQL runs on Spark and on DuckDB."""

# device logs: one row per event, with nulls, unknown levels and odd processes
LOGS = """
select event_id as record_id, ts as log_ts, user_id as device_id, value as metric,
  case when event_id % 37 = 5 then null
       when event_type in ('signup', 'error') then 'hostapd'
       when event_type = 'click' then 'wpa_supplicant'
       when event_type = 'view' then 'kernel' else 'dhcpd' end as process_name,
  case when event_id % 53 = 7 then null
       when event_id % 61 = 9 then 'NOTICE'
       when event_type = 'error' and user_id % 4 = 0 then 'CRITICAL'
       when event_type = 'error' then 'ERROR'
       when event_type = 'purchase' then 'WARNING'
       when event_type = 'view' then 'DEBUG' else 'INFO' end as log_level,
  case when event_id % 101 = 50 then ''
       when event_type = 'signup' then concat('AP-STA-CONNECTED ', {mac}, ' SSID=''net-', cast(user_id % 7 as string), ''' channel=', cast(1 + user_id % 11 as string), ' signal=-', cast(30 + user_id % 60 as string))
       when event_type = 'click' then concat('Trying to authenticate with ', {mac}, ' rate=', cast(6 + event_id % 48 as string), ' signal=-', cast(30 + event_id % 60 as string))
       when event_type = 'view' then concat('beacon from ', {mac}, ' channel=', cast(1 + event_id % 11 as string))
       when event_type = 'purchase' then concat('DHCPACK on 10.0.0.', cast(user_id % 250 as string), ' to ', {mac})
       when user_id % 3 = 0 then concat('ERROR: Authentication failure for ', {mac}, ' reason=', cast(event_id % 17 as string))
       when user_id % 3 = 1 then concat('Deauthenticated ', {mac}, ' reason=', cast(event_id % 5 as string), ' status=', cast(event_id % 23 as string))
       when user_id % 6 = 2 then concat('disassociation FAILED ', {mac}, ' status=', cast(event_id % 3 as string), ' packet_loss=', cast(event_id % 40 as string))
       else concat('association accepted ', {mac}, ' via 02:00:00:00:ff:', lpad(hex(event_id % 9), 2, '0')) end as message
from events
""".replace("{mac}", """concat('02:00:00:00:', lpad(hex(cast(floor(user_id / 256) as bigint)), 2, '0'), ':', lpad(hex(user_id % 256), 2, '0'))""")

# scored rows: the event value stands for the anomaly score
SCORED = """
select event_id as record_id, value as score, case when event_type = 'error' then 1 else 0 end as label
from events
"""


# records with planted faults, in files of 500 events; some records are repeated
DIRTY = f"""
select * from (
  select record_id * 2 as record_id, {{fields}} from ({LOGS}) as a
  union all
  select record_id * 2 + 1 as record_id, {{fields}} from ({LOGS}) as b where record_id % 50 = 1) as u
""".replace("{fields}", """concat('file-', lpad(cast(cast(floor(record_id / 500) as bigint) as string), 6, '0')) as file,
  case when record_id % 97 = 3 then 'yesterday' when record_id % 89 = 4 then '2024' when record_id % 83 = 2 then null
       when record_id % 211 = 10 and record_id % 2 = 1 then cast(log_ts - interval '3' day as string) else cast(log_ts as string) end as timestamp,
  case when record_id % 71 = 1 then null else message end as message, process_name, log_level""")

# JSON-line service logs, one line per event; some lines are blank or broken
SERVICE = """
select event_id as line, ts as log_ts,
  case when event_type = 'error' then 'ERROR' when event_type = 'purchase' then 'warning' when event_type = 'view' then 'DEBUG' else 'INFO' end as level,
  case when event_type = 'click' then 'http.access' when event_type = 'signup' then 'core.Features' else 'svc.pipe' end as logger,
  case when event_type = 'view' then concat('Progress of run: ', cast(event_id % 100 as string), '.5 % done')
       when event_type = 'error' then concat('Run failed, training_id: job-', cast(user_id as string))
       when event_type = 'purchase' then concat('Saved artefact for Training-ID ', cast(user_id as string))
       when event_type = 'signup' then 'loaded 12 columns' else concat('GET /health ', cast(event_id % 7 as string)) end as message,
  case when event_id % 3 = 0 then concat('job-', cast(user_id as string)) end as x_training_id,
  case when event_id % 11 = 0 then cast(event_id % 90 as double) end as x_progress,
  case when event_type = 'view' then 'scaling' end as x_step
from events
"""

# model registry rows and job events
MODELS = """
select concat('1.', cast(o_orderkey % 40 as string), '.', cast(o_orderkey as string), case when o_orderkey % 19 = 0 then '-beta' else '' end) as version,
  o_orderdate as created_at, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'local_outlier_factor' else 'isolation_forest' end as model_type,
  cast(floor(o_totalprice) as bigint) as training_samples, o_orderkey * 10 as size_bytes,
  case o_orderstatus when 'F' then 'available' when 'O' then 'deployed' else 'failed' end as status,
  case when o_orderkey % 3 = 0 then null else concat('job-', cast(o_custkey + 5 as string)) end as training_id
from orders
"""
JOB_EVENTS = """
select concat('job-', cast(user_id as string)) as training_id, ts as event_time, cast(event_id % 101 as double) as progress, event_type as step,
  case when event_type = 'error' and event_id % 2 = 0 then 'out of memory' end as error,
  case when event_type = 'purchase' then 'saved' end as result
from events
"""
EVALUATED = """
select o_orderkey as training_id, o_orderdate as updated_at, case when o_orderstatus = 'P' then 'running' else 'completed' end as status,
  o_orderkey % 7 <> 0 as evaluated, case when o_orderkey % 5 = 0 then null else o_orderkey % 4 <> 1 end as all_passed,
  case when o_orderkey % 6 = 0 then null else (o_orderkey % 100) / 100.0 end as accuracy,
  (o_custkey % 50) / 50.0 as f1_score, o_orderpriority as urgency
from orders
"""


def logs(spark, sf_dir):
    """The log view of one data folder."""
    return _run(spark, sf_dir, LOGS)


def scored(spark, sf_dir):
    return _run(spark, sf_dir, SCORED)


def dirty(spark, sf_dir):
    return _run(spark, sf_dir, DIRTY)


def service(spark, sf_dir):
    return _run(spark, sf_dir, SERVICE)


def models(spark, sf_dir):
    return _run(spark, sf_dir, MODELS, "orders")


def job_events(spark, sf_dir):
    return _run(spark, sf_dir, JOB_EVENTS)


def evaluated(spark, sf_dir):
    return _run(spark, sf_dir, EVALUATED, "orders")


def _run(spark, sf_dir, sql, table="events"):
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"from {table}", "from {source}"), source=source)


def with_view(name, view, body, *ctes):
    """SQL over one of the views, for DuckDB."""
    return f"with {name} as ({view})" + "".join(f", {c}" for c in ctes) + f" {body}"


def with_logs(body, *ctes):
    return with_view("logs", LOGS, body, *ctes)


def with_scored(body, *ctes):
    return with_view("scored", SCORED, body, *ctes)
