import datetime as dt

import pytest
from pyspark.sql import functions as F

from logprism.functions import features as fx
from logprism.operators.process import process_features


def one(spark, text, columns):
    return spark.createDataFrame([(text,)], "m string").select(
        *[c.alias(n) for n, c in columns.items()]).first().asDict()


def text(spark, value):
    return one(spark, value, {**fx.wifi_features(F.col("m")), **fx.text_features(F.col("m"))})


def test_addresses_are_complete_and_keep_their_case(spark):
    row = one(spark, "from 00:1a:2B:3c:4d:5e to AA-BB-CC-DD-EE-FF via 10.0.0.1, 999.1.1.1",
              {"macs": fx.mac_addresses(F.col("m")), "ips": fx.ip_addresses(F.col("m"))})
    assert row["macs"] == ["00:1a:2B:3c:4d:5e", "AA-BB-CC-DD-EE-FF"]
    assert row["ips"] == ["10.0.0.1", "999.1.1.1"]
    assert text(spark, "nothing here")["mac_count"] == 0


@pytest.mark.parametrize("message, flags", [
    ("ap-sta-connected 00:11:22:33:44:55", (1, 0, 0)),
    ("Deauthenticated: login DENIED", (0, 1, 1)),
    ("authentication failed", (0, 1, 1)),
    ("plain", (0, 0, 0)),
])
def test_event_flags(spark, message, flags):
    row = text(spark, message)
    assert (row["is_connection_event"], row["is_auth_event"], row["is_error_event"]) == flags


@pytest.mark.parametrize("value, words, special, digits, chars, capitals", [
    ("Hello World", 2, 0, 0, 8, 2),
    ("", 0, 0, 0, 0, 0),
    ("   ", 0, 0, 0, 1, 0),
    (" a\tb\n12-3! ", 3, 2, 3, 10, 0),
    ("naïve café ٣ x", 4, 3, 1, 12, 0),
    ("😀😀 A", 2, 2, 0, 3, 1),
])
def test_text_shape(spark, value, words, special, digits, chars, capitals):
    row = text(spark, value)
    assert row["word_count"] == len(value.split()) == words
    assert row["number_count"] == digits
    assert row["unique_chars"] == len(set(value)) == chars
    assert row["message_length"] == len(value)
    assert row["uppercase_ratio"] == pytest.approx(capitals / max(len(value), 1))
    assert row["special_char_count"] == special


def test_absent_message_gives_absent_features(spark):
    row = spark.createDataFrame([(None,)], "m string").select(
        *[c.alias(n) for n, c in fx.text_features(F.col("m")).items()]).first()
    assert row["word_count"] is None and row["unique_chars"] is None


def test_clock(spark):
    rows = [(dt.datetime(2024, 1, 6, 8, 59, 59),), (dt.datetime(2024, 1, 8, 9, 0, 0),), (dt.datetime(2024, 1, 8, 17, 0, 1),)]
    got = spark.createDataFrame(rows, "t timestamp_ntz").select(
        *[c.alias(n) for n, c in fx.time_features(F.col("t")).items()]).collect()
    assert [tuple(r) for r in got] == [
        (8, 5, 59, 8 * 3600 + 59 * 60 + 59, 1, 0), (9, 0, 0, 9 * 3600, 0, 1), (17, 0, 0, 17 * 3600 + 1, 0, 0)]


def test_levels(spark):
    rows = [(v,) for v in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "info", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(fx.level_number(F.col("l"))).collect()]
    assert got == [0, 1, 2, 3, 4, 1, 1]


def test_process_rank_is_dense_and_ascending(spark):
    rows = [("a",)] * 5 + [("b",)] * 2 + [("c",)] * 2 + [("d",)] + [(None,)] * 3
    got = {r["p"]: (r["process_rank"], r["process_frequency"])
           for r in process_features(spark.createDataFrame(rows, "p string"), "p").collect()}
    assert got == {"a": (3.0, 0.5), "b": (2.0, 0.2), "c": (2.0, 0.2), "d": (1.0, 0.1), None: (None, None)}


def test_twenty_names_in_order():
    assert len(fx.FEATURE_NAMES) == 20 == len(set(fx.FEATURE_NAMES))
    assert fx.FEATURE_NAMES[0] == "hour_of_day" and fx.FEATURE_NAMES[-1] == "process_frequency"


def test_record_features_stay_in_the_jvm(spark, sf_dir):
    from checks.views import logs

    df = logs(spark, sf_dir).withColumns({**fx.wifi_features(F.col("message")), **fx.text_features(F.col("message"))})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "props" not in plan  # the unused column is not read
