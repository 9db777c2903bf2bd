"""Stateful trailing windows of a stream equal those of the table."""

import random

import pytest
from pyspark.sql import functions as F

from logprism.operators.process import process_table
from logprism.operators.windows import WINDOW_FEATURES, window_features
from logprism.plans.features import extract_features, feature_names
from logprism.plans.scoring import score_features
from logprism.plans.training import Options, fit_features
from logprism.session import run_dir, store
from logprism.streaming import stateful, streams

LOGS = "id long, device string, log_ts timestamp, message string, process_name string, log_level string"
MESSAGES = ["AP-STA-CONNECTED 02:00:00:00:00:01", "x failed 02:00:00:00:00:02", "ERROR 02:00:00:00:00:01 02:00:00:00:00:03", "beacon", None]


def make_logs(spark, n=300, disorder=0, seed=1):
    """Rows in the order of arrival: by time, each up to ``disorder`` seconds late."""
    draw, at, rows = random.Random(seed), 0, []
    for k in range(n):
        at += draw.choice([0, 0, 1, 20, 200, 900])
        rows.append((at + draw.randrange(disorder + 1), (k, draw.choice(["a", "b", None]), at, draw.choice(MESSAGES), draw.choice(["p", "q", None]), "INFO")))
    rows = [r for _, r in sorted(rows, key=lambda r: r[0])]
    frame = spark.createDataFrame(rows, "id long, device string, s long, message string, process_name string, log_level string")
    frame = frame.withColumn("log_ts", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("s") * 1_000_000 + 7))
    return [r.id for r in frame.collect()], store(frame.select("id", "device", "log_ts", "message", "process_name", "log_level"), "logs")


def files(spark, frame, order, cuts):
    """The rows in this order, cut into files that a stream takes one by one."""
    path = run_dir(spark, "in")
    place = {i: k for k, i in enumerate(order)}
    size = -(-len(order) // cuts)
    for c in range(cuts):
        some = [i for i in order if place[i] // size == c]
        frame.filter(F.col("id").isin(some)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path, per_batch):
    return spark.readStream.schema(LOGS).option("maxFilesPerTrigger", per_batch).parquet(path)


def finish(spark, out, path=None, checkpoint=None):
    path, checkpoint = path or run_dir(spark, "out"), checkpoint or run_dir(spark, "offsets")
    streams.run_available(out, path, checkpoint)
    return spark.read.schema(out.schema).parquet(path)


@pytest.mark.parametrize("cuts, disorder, keys", [(1, 0, ["device"]), (4, 500, ["device"]), (3, 0, [])])
def test_equal_to_the_table(spark, cuts, disorder, keys):
    order, frame = make_logs(spark, disorder=disorder)
    out = stateful.stream_window_features(stream(spark, files(spark, frame, order, cuts), 1), keys=keys)
    assert out.columns == [*frame.columns, *WINDOW_FEATURES]
    got = {r.id: tuple(r) for r in finish(spark, out).collect()}
    last = frame.agg(F.max("log_ts")).first()[0]
    wanted = {r.id: tuple(r) for r in window_features(frame, keys=keys).select(out.columns).collect()}
    due = {i: w for i, w in wanted.items() if (last - w[2]).total_seconds() >= 600}
    assert got == due and 250 < len(due) < 300


def test_restart_goes_on_where_it_stopped(spark):
    """A second run with the same checkpoint sees new files only, and still knows the earlier ones' records."""
    order, frame = make_logs(spark)
    path, out, offsets = files(spark, frame.filter("id < 150"), [i for i in order if i < 150], 2), run_dir(spark, "out"), run_dir(spark, "offsets")
    finish(spark, stateful.stream_window_features(stream(spark, path, 1), keys=["device"]), out, offsets)
    frame.filter("id >= 150").coalesce(1).write.mode("append").parquet(path)
    got = finish(spark, stateful.stream_window_features(stream(spark, path, 1), keys=["device"]), out, offsets)
    wanted = {r.id: tuple(r) for r in window_features(frame, keys=["device"]).select(got.columns).collect()}
    rows = {r.id: tuple(r) for r in got.collect()}
    assert len(rows) > 250 and rows == {i: wanted[i] for i in rows}


def test_late_rows_and_rows_without_time_are_left_out(spark):
    base = "2024-01-01 00:00:00"
    times = [(0, 0), (1, 3600), (2, 7200), (3, 10), (4, 7300), (5, 20_000), (6, None)]
    frame = spark.createDataFrame([(i, "a", s) for i, s in times], "id long, device string, s long").select(
        "id", "device", (F.lit(base).cast("timestamp") + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))).alias("log_ts"),
        F.lit(MESSAGES[0]).alias("message"), F.lit("p").alias("process_name"), F.lit("INFO").alias("log_level"))
    path = files(spark, store(frame, "logs"), [i for i, _ in times], 7)
    got = {r.id: r.window_1hour_connection_count for r in finish(
        spark, stateful.stream_window_features(stream(spark, path, 1), keys=["device"])).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 4: 2}


def test_state_is_bounded_by_the_widest_window(spark):
    """After long silence of a key nothing of it is left but the newest records' state."""
    rows = [(k, "old" if k < 50 else "new", k * 30 if k < 50 else 40_000 + k * 30, None, "p", "INFO") for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, device string, s long, message string, process_name string, log_level string").select(
        "id", "device", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("s") * 1_000_000).alias("log_ts"), "message", "process_name", "log_level")
    path, offsets = files(spark, store(frame, "logs"), list(range(400)), 4), run_dir(spark, "offsets")
    finish(spark, stateful.stream_window_features(stream(spark, path, 1), keys=["device"]), None, offsets)
    recent = spark.read.format("statestore").option("path", offsets).option("stateVarName", "recent").load()
    left = recent.selectExpr("key.*", "user_map_value.*" if "user_map_value" in recent.columns else "*").collect()
    text = str(left)
    assert "old" not in text and 0 < len(left) <= 62


def test_scores_with_all_features(spark):
    order, frame = make_logs(spark)
    names = feature_names()
    features = store(extract_features(frame), "features")
    model = fit_features(features, names, "id", "v1", Options(trees=20, sample=64, all_medians=True))
    processes = store(process_table(frame), "processes")
    out = stateful.stream_feature_scores(stream(spark, files(spark, frame, order, 3), 1), model, processes)
    got = {r.id: r.anomaly_score for r in finish(spark, out).collect()}
    wanted = {r.id: r.anomaly_score for r in score_features(extract_features(frame, processes=processes), model, "training").collect()}
    assert len(got) > 250 and got == pytest.approx({i: wanted[i] for i in got})


class _State:
    """A state variable that counts its writes."""

    def __init__(self):
        self.values, self.list, self.writes = {}, [], 0

    exists = lambda self: bool(self.list)
    get = lambda self: iter(self.list)
    iterator = lambda self: iter(list(self.values.items()))

    def put(self, rows):
        self.list = list(rows)

    def clear(self):
        self.list = []

    def updateValue(self, key, value):
        self.values[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self.values[key]
        self.writes += 1


def test_minutes_out_of_reach_are_not_put_into_the_state():
    """Of a long history that leaves at once, only the minutes that later windows reach are stored, and old ones go."""
    minute = 60_000_000
    processor = stateful.TrailingWindows([5 * minute], ["w"])
    processor.waiting, processor.recent, processor.timer = _State(), _State(), _State()
    processor.wake = lambda micros: None

    def expire(watermark):
        times = type("Times", (), {"getCurrentWatermarkInMs": lambda self: watermark * 60_000})()
        return [v for frame in processor.handleExpiredTimer(None, times, None) for v in frame["w"]]

    processor.waiting.put([(k * minute, "[[1],[]]", str(k)) for k in range(100)])
    assert expire(99) == [min(k, 5) + 1 for k in range(100)]
    assert sorted(m for m, in processor.recent.values) == [94, 95, 96, 97, 98, 99] and processor.recent.writes == 6
    processor.waiting.put([(102 * minute, "[[1],[]]", "n")])
    assert expire(102) == [4]
    assert sorted(m for m, in processor.recent.values) == [97, 98, 99, 102] and processor.recent.writes == 6 + 3 + 1
