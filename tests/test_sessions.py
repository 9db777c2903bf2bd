"""Sessions, stability, load and trends of hand-made logs."""

import pytest
from pyspark.sql import functions as F

from logprism.operators import sessions as links
from logprism.session import store

ON, OFF = "AP-STA-CONNECTED 02:00:00:00:00:01 channel=6", "Deauthenticated 00:1a:00:00:00:02"


def logs(spark, *rows):
    """Rows (device, second of 2024-01-01, message)."""
    rows = [(device, None if s is None else float(s), message) for device, s, message in rows]
    frame = spark.createDataFrame(rows, "device_id string, s double, message string")
    base = 1_704_067_200_000_000
    return frame.withColumn("log_ts", F.timestamp_micros((F.lit(base) + F.col("s") * 1_000_000).cast("long"))).drop("s")


def seconds(us):
    return (us - 1_704_067_200_000_000) / 1e6


def test_pairs_of_connect_and_next_link_event(spark):
    frame = logs(spark, ("a", 10, ON), ("a", 5, OFF), ("a", 40, OFF), ("a", 50, OFF), ("a", 60, ON), ("a", 70, "beacon"), ("a", 80, ON),
                 ("b", 20, ON), ("b", 20, OFF), ("b", 20, ON), ("c", 99, "x"), (None, 1, ON), ("d", None, ON), ("d", 0, None))
    got = sorted((r.device, seconds(r.start_us), seconds(r.end_us), r.ended_by) for r in links.sessions(frame).collect())
    assert got == [("a", 10, 40, "disconnect"), ("a", 60, 80, "reconnect"), ("a", 80, 99, "open"), ("b", 20, 99, "open")]


def test_stability_and_load(spark):
    frame = logs(spark, ("a", 0, ON), ("a", 1800, OFF), ("b", 900, ON), ("b", 5400, OFF), ("c", 7200, "end"))
    found = store(links.sessions(frame), "sessions")
    stability = {r.device: r for r in links.connection_stability(found).collect()}
    assert stability["a"].connection_stability == pytest.approx(1800 / 7200) and stability["a"].drops == 1
    assert stability["b"].connection_stability == pytest.approx(4500 / 6300) and stability["b"].observed_seconds == 6300
    load = {seconds(r.hour_us): (r.mean_load, r.peak_load) for r in links.network_load(found).collect()}
    assert load == {0: (pytest.approx((1800 + 2700) / 3600), 2), 3600: (1.0, 1)}


def test_nothing_to_pair(spark):
    empty = links.sessions(logs(spark, ("a", 1, "x")))
    assert empty.count() == 0 and links.connection_stability(empty).count() == 0 and links.network_load(empty).count() == 0
    one = store(links.sessions(logs(spark, ("a", 1, ON))), "sessions")
    assert links.connection_stability(one).first().connection_stability is None
    assert [tuple(r)[1:] for r in links.network_load(one).collect()] == [(0.0, 0)]


def test_trend_and_kinds(spark):
    frame = logs(spark, ("a", 0, "signal=-40"), ("a", 3600, "signal=-50 02:00:00:00:00:01"), ("a", 7200, "signal=-60 channel=40"),
                 ("b", 0, "signal=-40"), ("b", 5, "signal=x"), ("c", 1, "channel=7 00:1A:00:00:00:02 channel=40"), ("c", 2, "channel=99999999999"))
    trend = {r.device: (r.readings, r.signal_strength_trend) for r in links.signal_trend(frame).collect()}
    assert trend == {"a": (3, pytest.approx(-10)), "b": (1, None)}
    kinds = {r.device: (r.device_type, r.connection_type, r.sessions) for r in links.link_features(frame).collect()}
    assert kinds == {"a": ("private", "5GHz", None), "b": (None, None, None), "c": ("vendor", "2.4GHz", None)}
