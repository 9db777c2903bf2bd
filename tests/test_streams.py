import json

from logprism.session import run_dir
from logprism.streaming import streams


def batches(spark, *groups):
    """A folder whose files are read one per micro-batch."""
    path = run_dir(spark, "stream-in")
    for rows in groups:
        lines = [json.dumps({"timestamp": t, "message": m, "process_name": "p", "log_level": "INFO"}) for t, m in rows]
        spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.mode("append").text(path)
    return streams.read_log_stream(spark, path, files_per_batch=1)


def finish(spark, stream):
    path = run_dir(spark, "stream-out")
    streams.run_available(stream, path, run_dir(spark, "offsets"))
    return spark.read.schema(stream.schema).parquet(path).collect()


def test_windows_close_at_the_watermark(spark):
    stream = batches(
        spark,
        [("2024-01-01T00:01:00Z", "AP-STA-CONNECTED"), ("2024-01-01T00:02:00Z", "x failed")],
        [("2024-01-01T01:00:00Z", "x")],
        [("2024-01-01T01:01:00Z", "x")],  # Spark drops late rows by the watermark of the batch before
        [("2024-01-01T00:03:00Z", "too late"), ("2024-01-01T02:00:00Z", "x")],
    )
    rows = finish(spark, streams.stream_window_counts(stream, 5))
    first = [r for r in rows if r["window_start"].hour == 0]
    assert [(r["events"], r["errors"], r["connections"]) for r in first] == [(2, 1, 1)]
    assert not any(r["window_start"].hour == 2 for r in rows)  # still open


def test_dedup_across_batches(spark):
    row = ("2024-01-01T00:01:00Z", "same")
    rows = finish(spark, streams.stream_dedup(batches(spark, [row, row], [row, ("2024-01-01T00:01:00Z", "other")])))
    assert sorted(r["message"] for r in rows) == ["other", "same"]


def test_sessions_end_with_the_gap(spark):
    day = "2024-01-01T"
    stream = batches(
        spark,
        [(f"{day}00:00:00Z", "AP-STA-CONNECTED"), (f"{day}00:04:00Z", "x failed"), (f"{day}00:09:00Z", "x")],
        [(f"{day}00:08:30Z", "late but in time"), (f"{day}02:00:00Z", "x")], [(f"{day}03:00:00Z", "x")])
    rows = finish(spark, streams.stream_sessions(stream, "5 minutes"))
    # a pause of the whole gap begins a new session, unless a record between them arrives in time
    assert sorted((r["session_start"].strftime("%H:%M:%S"), r["session_end"].strftime("%H:%M:%S"), r["events"], r["errors"], r["connections"])
                  for r in rows) == [("00:00:00", "00:14:00", 4, 1, 1), ("02:00:00", "02:05:00", 1, 0, 0)]


def test_first_records_over_all_history(spark):
    """Repeats are found over any time and after a restart; no watermark forgets them."""
    first, again = ("2024-01-01T00:00:00Z", "same"), ("2024-06-01T00:00:00Z", "new")
    path, out, offsets = run_dir(spark, "in"), run_dir(spark, "out"), run_dir(spark, "offsets")
    for rows in ([first, first], [again, first, ("2024-01-01T00:00:00Z", None)], [first, again, ("2024-01-01T00:00:00Z", None)]):
        lines = [json.dumps({"timestamp": t, "message": m, "process_name": "p", "log_level": "INFO"}) for t, m in rows]
        spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.mode("append").text(path)
        streams.run_available(streams.stream_first_records(streams.read_log_stream(spark, path)), out, offsets)
    got = sorted((r.timestamp, str(r.message)) for r in spark.read.parquet(out).collect())
    assert got == [(first[0], "None"), first, again]
