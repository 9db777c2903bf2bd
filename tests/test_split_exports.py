"""Documents read by byte ranges equal those read whole, wherever the ranges are cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from logprism.session import run_dir
from logprism.sources import exports
from logprism.sources import split_exports as split

ODD = ['plain', 'brace } in {text} [x]', 'quote \\" and \\\\', '"data": [{"a": 1}]', 'é 漢\\n', '}', '\\', '{"', '']


def record(draw, k):
    row = {"timestamp": f"2024-01-01T00:00:{k % 60:02d}Z", "message": draw.choice(ODD) * draw.randrange(4), "process_name": draw.choice(["p", "q}"]),
           "log_level": "INFO"}
    if draw.random() < 0.4:
        row["structured_data"] = {"a": draw.choice(ODD), "data": "[]"}
    if draw.random() < 0.2:
        row["push_attempts"] = k
    return row


def write(spark, **bodies):
    path = run_dir(spark, "documents")
    for name, body in bodies.items():
        # the text writer ends a file with a line break, which may stand behind a document
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/{name}.json")
    return path


@pytest.fixture
def small_ranges(spark):
    def size(value):
        spark.conf.set("spark.sql.files.maxPartitionBytes", value)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(frame):
    keep = [c for c in frame.columns if c != "file"]
    return sorted(map(str, frame.withColumn("file", F.regexp_extract("file", r"/(\w+)\.json/", 1)).select("file", *keep).collect()))


@pytest.mark.parametrize("size", ["60b", "131b", "64m"])
def test_ranges_of_any_size(spark, small_ranges, size):
    draw = random.Random(size)
    meta = {"created_at": "2024-01-01T00:00:00Z", "total_records": 3, "format": "json", "programs": ["data", "x]"], "export_id": '"data": ['}
    some = [record(draw, k) for k in range(40)]
    bodies = {
        "usual": json.dumps({"export_metadata": meta, "data": some}),
        "pretty": json.dumps({"data": some[:15], "export_metadata": meta, "more": [{"data": [{"a": 1}]}]}, indent=2, ensure_ascii=False),
        "lists": json.dumps({"tags": ["a", {"b": [1]}], "nested": {"data": [{"timestamp": "no"}]}, "data": some[:5]}),
        "empty": json.dumps({"export_metadata": meta, "data": []}),
        "long": json.dumps({"data": [some[0] | {"message": "x}{" * 2000}, some[1]]}),
    }
    path = write(spark, **bodies)
    whole = rows(exports.read_export(spark, path))
    small_ranges(size)
    assert rows(split.read_split_export(spark, path)) == whole and len(whole) == 62
    ranges, _ = split.export_ranges(spark, path)
    report = {r.file.split("/")[-2]: r for r in split.export_completeness(ranges).collect()}
    assert all(r.is_complete and r.has_data for r in report.values())
    assert report["usual.json"].records == 40 and report["empty.json"].records == 0
    if size == "131b":
        assert report["long.json"].ranges > 20


@pytest.mark.parametrize("size", ["75b", "64m"])
def test_broken_documents_are_reported(spark, small_ranges, size):
    draw = random.Random(1)
    body = json.dumps({"export_metadata": {"format": "json"}, "data": [record(draw, k) for k in range(6)]})
    third = body.index('{"timestamp": "2024-01-01T00:00:03Z"')
    small_ranges(size)
    path = write(spark, string=body[:third + 30], between=body[:third + len('{"timestamp": "2024-01-01T00:00:03Z"')], tail=body[:-1],
                 other='{"data": [1, null, "}", {"message": "a"}, [2], {"message": "b"}]}', none='{"records": []}', text="no json")
    ranges, counts = split.export_ranges(spark, path)
    report = {r.file.split("/")[-2].split(".")[0]: (r.has_data, r.records, r.is_complete) for r in split.export_completeness(ranges).collect()}
    assert report == {"string": (True, 3, False), "between": (True, 3, False), "tail": (True, 6, False), "other": (True, 2, True),
                      "none": (False, 0, True), "text": (False, 0, True)}
    texts = split.record_texts(spark, path, ranges, counts).collect()
    got = {}
    for r in sorted(texts, key=lambda r: r.record_idx):
        got.setdefault(r.file.split("/")[-2].split(".")[0], []).append(json.loads(r.text))
    assert {k: len(v) for k, v in got.items()} == {"string": 3, "between": 3, "tail": 6, "other": 2}
    assert [r["message"] for r in got["other"]] == ["a", "b"]
    with pytest.raises(ValueError, match="no data section"):
        split.read_split_export(spark, path)


def test_unselected_columns_are_not_parsed(spark):
    path = write(spark, one='{"data": [{"timestamp": "2024-01-01T00:00:00Z", "message": "m"}]}')
    plan = split.read_split_export(spark, path).select("message")._jdf.queryExecution().optimizedPlan().toString()
    assert "process_name" not in plan


def test_states_and_places_are_running_sums(spark):
    """Ranges of many files are told their state by Spark's own windows, not file by file in Python."""
    deltas = spark.createDataFrame([
        (file, block, 30, 10, quotes, plain, quoted) for file in ("a", "b")
        for block, quotes, plain, quoted in ((20, 2, -2, 0), (0, 1, 2, 0), (10, 1, 5, 1))] + [("c", 0, 9, 10, 0, -1, 0)], split.DELTAS_DDL)
    found = split.states(deltas)
    assert "Python" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "InPandas" not in plan
    got = {(r.file, r.block): (r.in_string, r.depth, r.unclosed, r.complete) for r in found.collect()}
    for file in ("a", "b"):
        assert [got[file, k] for k in (0, 10, 20)] == [(False, 0, False, False), (True, 2, False, False), (False, 3, False, False)]
    assert got["c", 0] == (False, 0, True, True)

    # begins in the second range, ends in the fourth; file "n" has no array, that of "s" ends where it begins
    counted = [("f", 0, 0, False, False, 0, False), ("f", 1, 7, False, True, 2, False), ("f", 2, 3, False, False, 0, False),
               ("f", 3, 1, True, True, 5, False), ("f", 4, 9, False, False, 0, False), ("n", 0, 4, True, False, 0, False),
               ("s", 0, 0, False, True, 2, True), ("s", 1, 6, False, False, 0, False)]
    counts = spark.createDataFrame(counted, "file string, block long, before long, ended boolean, begins boolean, after long, ended_after boolean")
    ranges = split.places(counts.selectExpr("*", "false as in_string", "0L as depth", "false as unclosed", "true as complete"))
    got = {(r.file, r.block): (r.inside, r.may_begin, r.first_record, r.records) for r in ranges.collect()}
    assert [got["f", k] for k in range(5)] == [
        (False, True, 0, 6), (False, True, 0, 6), (True, False, 2, 6), (True, False, 5, 6), (False, False, 6, 6)]
    assert got["n", 0] == (False, True, 0, -1)
    assert [got["s", k] for k in (0, 1)] == [(False, True, 0, 2), (False, False, 2, 2)]
