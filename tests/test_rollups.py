"""Roll-ups merged for any span equal the exact figures, or lie within their stated error."""

import pytest
from pyspark.sql import functions as F

from checks.views import logs
from logprism.operators import rollups
from logprism.session import run_dir, store


def test_merging_in_any_order_is_the_same(spark, sf_dir):
    frame = logs(spark, sf_dir)
    path = run_dir(spark, "rollup")
    rollups.write_rollup(rollups.hourly_rollup(frame, ["process_name"], metric="metric"), path)
    table = spark.read.parquet(path)
    once = rollups.rollup_summary(table).first().asDict()
    by_process = store(rollups.merged(table, ["process_name"]), "merged")
    twice = rollups.rollup_summary(by_process).first().asDict()
    for name, value in once.items():
        if isinstance(value, float):
            assert twice[name] == pytest.approx(value, rel=0.05 if "p9" in name or "p5" in name else 1e-9)
        elif name not in {f"{k}_codes" for k in rollups.CODES} and not name.startswith("length_p"):
            assert twice[name] == value, name
    assert once["rows"] == frame.count()


def test_spans_read_their_days_only(spark, sf_dir):
    path = run_dir(spark, "rollup")
    rollups.write_rollup(rollups.hourly_rollup(logs(spark, sf_dir)), path)
    some = rollups.span(spark.read.parquet(path), "2024-01-03 00:00:00", "2024-01-05 06:00:00")
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().executedPlan().toString()
    wanted = logs(spark, sf_dir).filter("log_ts >= '2024-01-03 00:00:00' and log_ts < '2024-01-05 06:00:00'").count()
    assert rollups.rollup_summary(some).first()["rows"] == wanted > 0


def test_nothing_and_rows_without_time(spark):
    schema = "log_ts timestamp, message string, log_level string, device_id long, metric double"
    none = rollups.rollup_summary(rollups.hourly_rollup(spark.createDataFrame([(None, "x", "ERROR", 1, 1.0)], schema), metric="metric"))
    assert none.count() == 0
    one = spark.createDataFrame([(None, None, None, None)], "message string, log_level string, device_id long, metric double").withColumn(
        "log_ts", F.lit("2024-01-01 10:20:00").cast("timestamp"))
    row = rollups.rollup_summary(rollups.hourly_rollup(one, metric="metric")).first()
    assert (row["rows"], row["devices"], row["macs"], row["length_p50"], row["metric_p50"], row["mean_signal"]) == (1, 0, 0, 0, None, None)
