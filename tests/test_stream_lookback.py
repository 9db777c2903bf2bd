"""Scores of a stream do not depend on how the logs are cut into batches."""

import pytest
from pyspark.sql import functions as F

from logprism.operators.process import process_table
from logprism.plans.features import extract_features, feature_names
from logprism.plans.scoring import score_features
from logprism.plans.training import Options, fit_features
from logprism.session import run_dir, store
from logprism.sources import model_store
from logprism.streaming import streams


def test_look_back_over_earlier_batches(spark):
    rows = spark.range(120).select(
        F.format_string("2024-01-01T%02d:%02d:00Z", (F.col("id") * 7 / 60).cast("int"), F.col("id") * 7 % 60).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "AP-STA-CONNECTED 02:00:00:00:00:01").otherwise("x failed").alias("message"),
        F.concat(F.lit("p"), F.col("id") % 4).alias("process_name"), F.lit("INFO").alias("log_level"))
    path = run_dir(spark, "in")
    for part in range(6):  # files in the order of time
        rows.filter((F.col("timestamp") >= f"2024-01-01T{part * 3:02d}") & (
            F.col("timestamp") < f"2024-01-01T{part * 3 + 3:02d}")).coalesce(1).write.mode("append").json(path)
    names = feature_names()
    logs = streams.read_log_stream(spark, path).isStreaming and store(
        spark.read.schema(streams.RECORD_FIELDS).json(path).withColumn("log_ts", F.to_timestamp("timestamp")), "logs")
    features = store(extract_features(logs), "features")
    model = fit_features(features, names, "timestamp", "v1", Options(trees=20, sample=64, all_medians=True))
    metadata = model_store.build_metadata("v1", "2024-02-01T00:00:00", "isolation_forest", model.scaler.rows, names, {}, {}, {})
    root = run_dir(spark, "models")
    model_store.save_model(spark, model_store.Model("v1", model.scaler, model.nodes, model.offset, metadata), root)
    model_store.deploy_model(spark, root, "v1", "2024-02-02T00:00:00")
    whole = {r.timestamp: r.anomaly_score for r in score_features(
        extract_features(logs, processes=process_table(logs)), model, "training").collect()}
    for files in (1, 10):
        out = run_dir(spark, "scored")
        streams.score_with_reload(
            streams.read_log_stream(spark, path, files), root, out, run_dir(spark, "offsets"),
            history=run_dir(spark, "history"), reference=logs)
        got = spark.read.parquet(out).select("timestamp", "anomaly_score", "model_version").collect()
        assert {r.model_version for r in got} == {"v1"}
        assert {r.timestamp: r.anomaly_score for r in got} == pytest.approx(whole)


def test_full_scores_need_history(spark):
    with pytest.raises(ValueError):
        streams.score_with_reload(None, "r", "p", "c")


def test_feature_plan_is_narrow(spark, sf_dir):
    """The message stays out of every exchange, and no exchange gathers rows in one task."""
    from checks.views import logs

    frame = extract_features(logs(spark, sf_dir), keep=["record_id"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "message#" not in plan
    assert plan.count("event_type") == 0  # the logs are not read again after the stored pass
