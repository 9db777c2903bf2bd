"""Forest, outlier factor, scoring results, folds, drift and streams."""

from pyspark.sql import functions as F

from checks.views import LOGS, logs, scored, with_logs, with_scored
from logprism.functions import fixed
from logprism.operators import forest as forest_ops
from logprism.operators.distribution import distribution, percentiles
from logprism.operators.drift import drift_report
from logprism.operators.lof import local_outlier_factor
from logprism.plans import scoring, training
from logprism.plans.features import extract_features, feature_names
from logprism.session import run_dir
from logprism.sources import model_store
from logprism.streaming import streams


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- given scores --------------------------------------------------------------

def _predicted(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumnRenamed("score", "anomaly_score")
    normality = rows.select((-F.col("anomaly_score")).alias("v"))
    offset = percentiles(distribution(normality, "v"), "v", {"cut": fixed.CONTAMINATION}).first()["cut"]
    return forest_ops.predict(rows, offset)


def decision_and_prediction(spark, sf_dir):
    return _rounded(_predicted(spark, sf_dir).select("record_id", "decision", "prediction"))


def prediction_summary(spark, sf_dir):
    return _rounded(scoring.prediction_summary(_predicted(spark, sf_dir)))


def flag_summary(spark, sf_dir):
    return _rounded(scoring.flag_summary(scoring.flag(scored(spark, sf_dir), score="score"), score="score"))


def flags_at_25(spark, sf_dir):
    return scoring.flag(scored(spark, sf_dir), at=25.0, score="score").select("record_id", "flagged")


def _shown(by_score):
    def query(spark, sf_dir):
        rows = logs(spark, sf_dir).join(_predicted(spark, sf_dir).select("record_id", "prediction", "anomaly_score"), "record_id")
        out = scoring.show_anomalies(rows, "record_id", by_score=by_score)
        return out.select("record_id", "process_name", "message_start")
    return query


def cv_folds(spark, sf_dir):
    return training.assign_folds(logs(spark, sf_dir).select("record_id"), "record_id")


# --- models ----------------------------------------------------------------------

def _stored_features(spark, sf_dir):
    path = run_dir(spark, "features")
    extract_features(logs(spark, sf_dir)).select(
        "record_id", "log_ts", "process_name", "message", *feature_names()).write.parquet(path)
    return spark.read.parquet(path)


def forest_scores(spark, sf_dir):
    features = _stored_features(spark, sf_dir)
    model = training.fit_features(features, feature_names(), "record_id", "v1")
    return scoring.score_features(features, model).select("record_id", "anomaly_score", "decision", "prediction")


def forest_sample(spark, sf_dir):
    """Rows per tree of several tables and sizes: the sample size, or all rows, whatever the table holds."""
    out = None
    for table, key, size in (("events", "event_id", 256), ("events", "event_id", 16), ("embeddings", "vec_id", 256)):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("record_id"))
        picked = forest_ops.sample_rows(rows, "record_id", rows.count(), fixed.TREES, size, fixed.SEED)
        counts = picked.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("different"))
        counts = counts.select(F.lit(table).alias("sampled"), F.lit(size).alias("size"), "*")
        out = counts if out is None else out.unionByName(counts)
    return out


def train_lof(spark, sf_dir):
    """The second model type through a training run: its predictions at the cut."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    options = training.Options(model_type="local_outlier_factor", neighbours=10)
    _, scored, offset = training.score_outlier_factor(customers, ["balance", "nation"], "c_custkey", options)
    return _rounded(scored.select("c_custkey", F.col("anomaly_score").alias("lof"), "prediction"))


def train_report(spark, sf_dir):
    """The report of a training run, its stored registry row, and what holds of every forest."""
    root = run_dir(spark, "models")
    training.train(spark, logs(spark, sf_dir), "record_id", "v1", "2024-02-01T00:00:00", root)
    model_store.deploy_model(spark, root, "v1", "2024-02-02T00:00:00", "check")
    model = model_store.load_model(spark, root, "v1")
    _, frames, report = training.train(
        spark, logs(spark, sf_dir), "record_id", "v2", "2024-02-01T00:00:00", require=False)
    stored = model_store.read_registry(spark, root).select(F.struct("status", "training_samples")).scalar()
    nodes = model.nodes
    leaf = F.col("feature") < 0
    trees = nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root"), F.sum(F.when(leaf, F.col("size"))).alias("leaves"),
        F.max("depth").alias("depth"))
    shape = trees.agg(F.struct(
        F.count("*").alias("trees"), F.min("root").alias("root"), F.min("leaves").alias("leaves"),
        (F.max("depth") <= 8).alias("bounded"))).scalar()
    share = scoring.prediction_summary(frames["scored"]).select("anomaly_rate").scalar()
    return report.select(
        F.col("status").alias("run"), "version", "model_type", "training_samples", "feature_count",
        F.array_join("feature_names", ",").alias("feature_names"), (F.col("training_duration") > 0).alias("timed"),
        F.array_join(F.array_sort(F.map_keys("checks")), ",").alias("checks"),
        (F.size("recommendations") >= 0).alias("advised"),
        stored["status"].alias("stored_status"), stored["training_samples"].alias("stored_samples"),
        *[shape[c].alias(c) for c in ("trees", "root", "leaves", "bounded")], share.between(0.09, 0.11).alias("tenth"))


#: A forest of two small trees over three columns, so that its scores can be told in SQL.
FIXED_FEATURES = ("metric", "device", "hour")
FIXED_NODES = (
    (0, 0, 0, 0.0, 1, 2, 8, 0), (0, 1, -1, 0.0, 1, 1, 3, 1), (0, 2, 2, 0.5, 3, 4, 5, 1),
    (0, 3, -1, 0.0, 3, 3, 4, 2), (0, 4, -1, 0.0, 4, 4, 1, 2),
    (1, 0, 1, -0.25, 1, 2, 8, 0), (1, 1, -1, 0.0, 1, 1, 2, 1), (1, 2, -1, 0.0, 2, 2, 6, 1),
)


def _fixed_model(spark, sf_dir):
    rows = logs(spark, sf_dir).select(
        "record_id", F.col("metric").cast("double"), F.col("device_id").cast("double").alias("device"),
        F.hour("log_ts").cast("double").alias("hour"))
    nodes = spark.createDataFrame(list(FIXED_NODES), forest_ops.NODE_SCHEMA)
    return rows, model_store.Model("fixed", scoring_scaler(rows), nodes, -0.5)


def scoring_scaler(rows):
    from logprism.operators.scaling import Scaler

    return Scaler.fit(rows, FIXED_FEATURES)


def fixed_forest_scores(spark, sf_dir):
    """Filling, scaling, tree walks, cut and decision of a given model, row by row."""
    rows, model = _fixed_model(spark, sf_dir)
    return _rounded(scoring.score_features(rows, model))


def fixed_forest_stored(spark, sf_dir):
    """The same model saved, loaded and applied, with its predictions summed up."""
    rows, model = _fixed_model(spark, sf_dir)
    root = run_dir(spark, "models")
    metadata = model_store.build_metadata("fixed", "2024-01-01T00:00:00", "isolation_forest", model.scaler.rows,
                                          FIXED_FEATURES, {}, {}, {})
    model_store.save_model(spark, model_store.Model("fixed", model.scaler, model.nodes, model.offset, metadata), root)
    return _rounded(scoring.prediction_summary(scoring.score_features(rows, model_store.load_model(spark, root, "fixed"))))


def cross_validation(spark, sf_dir):
    features = _stored_features(spark, sf_dir)
    label = (F.col("log_level_numeric") >= 3).cast("int")
    return training.cross_validate(features, feature_names(), "record_id", label)


def permutation_importance(spark, sf_dir):
    features = _stored_features(spark, sf_dir)
    model = training.fit_features(features, feature_names(), "record_id", "v1")
    return training.permutation_importance(features, model, "record_id")


def _wide_embeddings(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = len(table.select("embedding").first()[0])
    names = [f"e{i}" for i in range(size)]
    return table.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


def lof_embeddings(spark, sf_dir):
    wide, names = _wide_embeddings(spark, sf_dir)
    return _rounded(local_outlier_factor(wide, names, "vec_id").select("vec_id", "lof", "prediction"))


def lof_customers(spark, sf_dir):
    """One feature, whole table; many customers share a rounded balance."""
    table = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.floor(F.col("c_acctbal") / 100).cast("double").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"))
    return _rounded(local_outlier_factor(table, ["balance", "nation"], "c_custkey", k=10).select("c_custkey", "lof"))


# --- drift and streams -------------------------------------------------------------

def drift(spark, sf_dir):
    rows = logs(spark, sf_dir).select(
        "log_ts", "metric", F.col("device_id").cast("double").alias("device"),
        F.length("message").alias("message_length"), F.hour("log_ts").alias("hour"))
    rows = rows.withColumn("aged", F.col("metric") + F.day("log_ts"))
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    names = ["metric", "device", "message_length", "hour", "aged"]
    return _rounded(drift_report(rows.filter(F.col("log_ts") < cut), rows.filter(F.col("log_ts") >= cut), names))


def _log_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = spark.sql(LOGS.replace("from events", "from {source}"), source=source)
    return stream.withColumn("log_ts", F.col("log_ts").cast("timestamp"))


def _finished(spark, stream):
    path = run_dir(spark, "stream")
    streams.run_available(stream, path, run_dir(spark, "offsets"))
    return spark.read.schema(stream.schema).parquet(path)


def stream_window_counts(spark, sf_dir):
    out = _finished(spark, streams.stream_window_counts(_log_stream(spark, sf_dir), 15, keys=["process_name"]))
    return out.select(F.unix_micros("window_start").alias("start_micros"), "process_name", "events", "errors", "connections")


def stream_sliding_counts(spark, sf_dir):
    out = _finished(spark, streams.stream_window_counts(_log_stream(spark, sf_dir), 60, 15))
    return out.select(F.unix_micros("window_start").alias("start_micros"), "events", "errors", "connections")


def stream_dedup(spark, sf_dir):
    rows = _log_stream(spark, sf_dir).withColumn("log_ts", F.date_trunc("hour", "log_ts"))
    out = _finished(spark, streams.stream_dedup(rows, fields=("log_ts", "process_name")))
    return out.groupBy("process_name").agg(F.count("*").alias("n"))


def _record_model(spark, sf_dir):
    path = run_dir(spark, "features")
    streams.record_features(logs(spark, sf_dir)).select("record_id", *streams.STREAM_FEATURES).write.parquet(path)
    options = training.Options(all_medians=True)
    return training.fit_features(spark.read.parquet(path), streams.STREAM_FEATURES, "record_id", "s1", options)


def stream_scores(spark, sf_dir):
    model = _record_model(spark, sf_dir)
    return _finished(spark, streams.stream_scores(_log_stream(spark, sf_dir), model).select(
        "record_id", "anomaly_score", "prediction"))


def stream_scores_reload(spark, sf_dir):
    model = _record_model(spark, sf_dir)
    metadata = model_store.build_metadata(
        "s1", "2024-02-01T00:00:00", "isolation_forest", model.scaler.rows, model.scaler.features, {}, {}, {})
    model = model_store.Model("s1", model.scaler, model.nodes, model.offset, metadata)
    root, path = run_dir(spark, "models"), run_dir(spark, "scored")
    model_store.save_model(spark, model, root)
    model_store.deploy_model(spark, root, "s1", "2024-02-02T00:00:00")
    streams.score_with_reload(_log_stream(spark, sf_dir), root, path, run_dir(spark, "offsets"), streams.stream_scores)
    return spark.read.parquet(path).groupBy("model_version").agg(F.count("*").alias("n"))


QUERIES = {
    "decision_and_prediction": decision_and_prediction,
    "prediction_summary": prediction_summary,
    "flag_summary": flag_summary,
    "flags_at_25": flags_at_25,
    "first_anomalies": _shown(None),
    "top_anomalies": _shown("anomaly_score"),
    "cv_folds": cv_folds,
    "forest_sample": forest_sample,
    "fixed_forest_scores": fixed_forest_scores,
    "fixed_forest_stored": fixed_forest_stored,
    "train_lof": train_lof,
    "forest_scores": forest_scores,
    "train_report": train_report,
    "cross_validation": cross_validation,
    "permutation_importance": permutation_importance,
    "lof_embeddings": lof_embeddings,
    "lof_customers": lof_customers,
    "drift": drift,
    "stream_window_counts": stream_window_counts,
    "stream_sliding_counts": stream_sliding_counts,
    "stream_dedup": stream_dedup,
    "stream_scores": stream_scores,
    "stream_scores_reload": stream_scores_reload,
}

# --- SQL ---------------------------------------------------------------------------

_PREDICTED = """cutoff as (select quantile_cont(-score, 0.1) as o from scored),
  predicted as (select record_id, score, -score - o as decision, case when -score - o < 0 then -1 else 1 end as prediction from scored, cutoff)"""
_CUT = "cut as (select quantile_cont(score, 0.9) as t from scored)"


def _lof(points, k):
    """Breunig's definition over all pairs of (id, x)."""
    return f"""with pts as ({points}),
  pairs as (select a.id as p, b.id as o, list_distance(a.x, b.x) as d from pts a join pts b on a.id <> b.id),
  ranked as (select *, row_number() over (partition by p order by d) as r from pairs),
  kd as (select p, max(d) as kd from ranked where r <= {k} group by 1),
  nb as (select pairs.p, o, d from pairs join kd on pairs.p = kd.p where d <= kd),
  lrd as (select nb.p, 1.0 / (avg(greatest(d, kd.kd)) + 1e-10) as l from nb join kd on nb.o = kd.p group by 1),
  fac as (select nb.p as id, avg(b.l) / any_value(a.l) as lof from nb join lrd a on a.p = nb.p join lrd b on b.p = nb.o group by 1)"""


def _psi(expression, name):
    edges = ", ".join(f"quantile_cont(v, {i / 10}) filter (where old)" for i in range(1, 10))
    return f"""select '{name}' as feature, any_value(ra) as rows_train, any_value(rb) as rows_current, round(sum((q - p) * ln(q / p)), 6) as shift from
      (select ra, rb, greatest(a / cast(ra as double), 1e-4) as p, greatest(b / cast(rb as double), 1e-4) as q from
        (select g.b as bucket, count(v) filter (where old) as a, count(v) filter (where not old) as b from
          (select unnest(range(0, n + 1)) as b from (select len(list_distinct([{edges}])) as n from (select {expression} as v, old from parts))) g
          left join (select v, old, (select len(list_filter(list_distinct(e), lambda x: x < v)) from (select [{edges}] as e from (select {expression} as v, old from parts))) as bucket
                     from (select {expression} as v, old from parts)) s on s.bucket = g.b group by 1),
        (select count(*) filter (where old) as ra, count(*) filter (where not old) as rb from parts))"""


_DRIFT = " union all ".join(_psi(e, n) for e, n in (
    ("metric", "metric"), ("cast(device_id as double)", "device"), ("cast(length(message) as double)", "message_length"),
    ("cast(hour(log_ts) as double)", "hour"), ("metric + day(log_ts)", "aged")))


def _path(size):
    """Mean path length that a leaf of so many rows stands for, as SQL."""
    return "0.0" if size <= 1 else "1.0" if size == 2 else f"(2 * (ln({size - 1}) + 0.5772156649) - 2 * {size - 1} / {size}.0)"


_FIXED = with_logs(f"""select record_id, score as anomaly_score, 0.5 - score as decision, case when 0.5 - score < 0 then -1 else 1 end as prediction
  from (select record_id, power(2.0, -(
      case when m <= 0 then 1 + {_path(3)} when h <= 0.5 then 2 + {_path(4)} else 2 + {_path(1)} end
      + case when d <= -0.25 then 1 + {_path(2)} else 1 + {_path(6)} end) / (2 * {_path(8)})) as score from z)""",
    """z as (select record_id, (m - avg(m) over ()) / stddev_pop(m) over () as m, (d - avg(d) over ()) / stddev_pop(d) over () as d,
      (h - avg(h) over ()) / stddev_pop(h) over () as h from (
        select record_id, coalesce(m, (select median(metric) from logs)) as m, d, h from (
          select record_id, metric as m, cast(device_id as double) as d, cast(hour(log_ts) as double) as h from logs)))""")


def _stream_counts(width, slide, key=""):
    by = f"{key}, " if key else ""
    shifts = " union all ".join(f"select {i * slide} as s" for i in range(width // slide))
    return with_logs(f"""select epoch_us(w) as start_micros, {by} count(*) as events,
        count(*) filter (where regexp_matches(message, 'ERROR|FAILED', 'i')) as errors, count(*) filter (where regexp_matches(message, 'AP-STA-CONNECTED', 'i')) as connections
        from (select *, time_bucket(interval '{slide} minutes', log_ts) - to_minutes(s) as w from logs, ({shifts}))
        where w + interval '{width} minutes' <= (select date_trunc('milliseconds', max(log_ts)) - interval '10 minutes' from logs) group by all""")


SQL = {
    "decision_and_prediction": with_scored("select record_id, round(decision, 6) as decision, prediction from predicted", _PREDICTED),
    "prediction_summary": with_scored("""select count(*) as total_samples, count(*) filter (where prediction = 1) as normal_count,
        count(*) filter (where prediction = -1) as anomaly_count, round(avg(case when prediction = -1 then 1.0 else 0.0 end), 6) as anomaly_rate,
        round(avg(decision), 6) as mean_decision, round(stddev_pop(decision), 6) as std_decision from predicted""", _PREDICTED),
    "flag_summary": with_scored("""select count(*) as total_samples, count(*) filter (where score <= t) as normal_count, count(*) filter (where score > t) as anomaly_count,
        round(avg(case when score > t then 1.0 else 0.0 end), 6) as anomaly_rate, round(avg(score), 6) as average_score,
        round(stddev_pop(score), 6) as score_std, round(max(t), 6) as threshold from scored, cut""", _CUT),
    "flags_at_25": with_scored("select record_id, case when score > 25 then 1 else 0 end as flagged from scored"),
    "first_anomalies": with_logs("""select record_id, process_name, message_start from (select l.record_id, process_name, substring(message, 1, 100) as message_start
        from logs l, (select quantile_cont(metric, 0.9) as t from logs) where metric > t order by record_id limit 5)"""),
    "top_anomalies": with_logs("""select record_id, process_name, message_start from (select l.record_id, process_name, substring(message, 1, 100) as message_start
        from logs l, (select quantile_cont(metric, 0.9) as t from logs) where metric > t order by metric desc, record_id limit 5)"""),
    "cv_folds": with_logs("select record_id, cast(ntile(5) over (order by record_id) - 1 as integer) as fold from logs"),
    "fixed_forest_scores": f"select record_id, round(anomaly_score, 6) as anomaly_score, round(decision, 6) as decision, prediction from ({_FIXED})",
    "fixed_forest_stored": f"""select count(*) as total_samples, count(*) filter (where prediction = 1) as normal_count,
        count(*) filter (where prediction = -1) as anomaly_count, round(avg(cast(prediction = -1 as int)), 6) as anomaly_rate,
        round(avg(decision), 6) as mean_decision, round(stddev_pop(decision), 6) as std_decision from ({_FIXED})""",
    "train_report": f"""select 'completed' as run, 'v2' as version, 'isolation_forest' as model_type, count(*) as training_samples,
        {len(feature_names())} as feature_count, '{",".join(feature_names())}' as feature_names, true as timed,
        'anomaly_ratio,score_distribution,score_mean,score_std' as checks, true as advised, 'deployed' as stored_status, count(*) as stored_samples,
        100 as trees, least(256, count(*)) as root, least(256, count(*)) as leaves, true as bounded, true as tenth from events""",
    "forest_sample": """select sampled, size, tree, least(size, n) as n, least(size, n) as different
        from (select unnest(range(0, 100)) as tree), (
            select 'events' as sampled, 256 as size, count(*) as n from events
            union all select 'events', 16, count(*) from events
            union all select 'embeddings', 256, count(*) from embeddings)""",
    "train_lof": _lof("""select c_custkey as id, [
            (c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over (),
            (c_nationkey - avg(c_nationkey) over ()) / stddev_pop(c_nationkey) over ()] as x from customer""", 10)
        + " select id as c_custkey, round(lof, 6) as lof, case when -lof < (select quantile_cont(-lof, 0.1) from fac) then -1 else 1 end as prediction from fac",
    "lof_embeddings": _lof("select vec_id as id, cast(embedding as double[]) as x from embeddings", 20) + """
        select id as vec_id, round(lof, 6) as lof, case when -lof < (select quantile_cont(-lof, 0.1) from fac) then -1 else 1 end as prediction from fac""",
    "lof_customers": _lof("select c_custkey as id, [cast(floor(c_acctbal / 100) as double), cast(c_nationkey as double)] as x from customer", 10)
        + " select id as c_custkey, round(lof, 6) as lof from fac",
    "drift": with_logs(f"select *, cast(0.1 as double) as threshold, shift > 0.1 as drifted from ({_DRIFT})",
                       "parts as (select *, log_ts < timestamp '2024-01-16' as old from logs)"),
    "stream_window_counts": _stream_counts(15, 15, "process_name"),
    "stream_sliding_counts": _stream_counts(60, 15),
    "stream_dedup": with_logs("select process_name, count(distinct date_trunc('hour', log_ts)) as n from logs group by 1"),
    "stream_scores_reload": "select 's1' as model_version, count(*) as n from events",
}
