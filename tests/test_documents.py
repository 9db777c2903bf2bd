import json

import pytest
from pyspark.sql import functions as F

from logprism.functions import formats
from logprism.operators import loganalytics as la
from logprism.operators import quality
from logprism.session import run_dir
from logprism.sources import exports, files
from logprism.sources import logs as log_source

GOOD_META = {"created_at": "2024-01-01T00:00:00Z", "total_records": 100, "format": "json"}


def record(**changes):
    base = {"timestamp": "2024-01-01T00:00:00Z", "message": "m", "process_name": "p", "log_level": "INFO"}
    return {k: v for k, v in (base | changes).items() if v != "ABSENT"}


def documents(spark, *bodies):
    rows = [(f"f{i}", len(b), b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "file string, size_bytes long, body string")


def found(spark, body, lenient=False):
    body = body if isinstance(body, str) else json.dumps(body)
    rows = quality.validate_documents(documents(spark, body), lenient).collect()
    return sorted((r["rule"], r["record_idx"]) for r in rows)


@pytest.mark.parametrize("body, rules", [
    ("{nope", ["invalid_json"]),
    ("[1]", ["invalid_json"]),
    ({}, ["missing_data", "missing_export_metadata"]),
    ({"export_metadata": 3, "data": {}}, ["data_not_array", "export_metadata_not_object"]),
    ({"export_metadata": GOOD_META, "data": None}, ["data_not_array"]),
    ({"export_metadata": GOOD_META, "data": "[1]"}, ["data_not_array"]),
    ({"export_metadata": GOOD_META, "data": []}, ["empty_data"]),
    ({"export_metadata": {}, "data": [record()]},
     ["missing_metadata_created_at", "missing_metadata_format", "missing_metadata_total_records"]),
    ({"export_metadata": {"created_at": "soon", "total_records": "5", "format": "csv"}, "data": [record()]},
     ["invalid_created_at", "invalid_total_records", "unsupported_format"]),
    ({"export_metadata": GOOD_META | {"total_records": -1}, "data": [record()]}, ["invalid_total_records"]),
    ({"export_metadata": GOOD_META | {"total_records": 1.5}, "data": [record()]}, ["invalid_total_records"]),
    ({"export_metadata": GOOD_META | {"total_records": 0}, "data": [record()]}, []),
])
def test_structure_and_metadata(spark, body, rules):
    assert [r for r, _ in found(spark, body)] == rules


@pytest.mark.parametrize("changes, rules", [
    ({}, []),
    ({"message": "ABSENT"}, ["missing_message"]),
    ({"message": None}, ["message_not_string"]),
    ({"process_name": 7}, ["process_name_not_string"]),
    ({"log_level": "info"}, ["invalid_log_level"]),
    ({"log_level": None}, ["invalid_log_level"]),
    ({"timestamp": "2024"}, ["invalid_timestamp"]),
    ({"timestamp": "2024-13-01T00:00:00Z"}, ["invalid_timestamp"]),
    ({"timestamp": 5}, ["invalid_timestamp"]),
    ({"timestamp": "2024-01-01T10:00:00+02:00"}, []),
])
def test_records(spark, changes, rules):
    got = found(spark, {"export_metadata": GOOD_META, "data": [record(**changes)]})
    assert got == [(r, 0) for r in rules]


def test_lenient_records(spark):
    body = {"data": [record(log_level="ABSENT"), record(structured_data=[1]), record(structured_data={"a": 1}), record(timestamp=4)]}
    assert found(spark, body, lenient=True) == [("structured_data_not_object", 1), ("timestamp_not_string", 3)]


def test_order_and_repeats(spark):
    data = [record(timestamp=f"2024-01-01T00:00:0{s}Z") for s in (1, 2, 2, 5, 2)] + [record(timestamp="x", message="b")]
    assert found(spark, {"export_metadata": GOOD_META, "data": data}) == [
        ("duplicate", 2), ("duplicate", 4), ("invalid_timestamp", 5), ("not_chronological", None)]


def test_mixed_zones_are_compared_in_utc(spark):
    data = [record(timestamp="2024-01-01T02:00:00+02:00"), record(timestamp="2024-01-01T00:00:01")]
    assert found(spark, {"export_metadata": GOOD_META, "data": data}) == []


def test_report_counts(spark):
    good = json.dumps({"export_metadata": GOOD_META, "data": [record()]})
    docs = documents(spark, good, "{", json.dumps({"data": []}))
    report = quality.validation_report(docs, quality.validate_documents(docs))
    assert {r["file"]: (r["is_valid"], r["errors"]) for r in report.collect()} == {
        "f0": (True, {}), "f1": (False, {"invalid_json": 1}), "f2": (False, {"missing_export_metadata": 1})}
    assert tuple(quality.directory_report(report).first()) == (3, 1, 2)


def test_suitability(spark):
    rows = [("hostapd", "2024-01-01T00:00:00"), ("wpa_supplicant", "2024-01-01T00:01:00"), ("hostapd", "2024-01-01T00:02:00")]
    df = spark.createDataFrame(rows, "process_name string, t string").withColumn("log_ts", formats.parse_iso(F.col("t")))
    row = quality.training_suitability(df).first()
    assert (row["total_records"], row["wifi_logs"], row["wifi_ratio"], row["time_range_days"]) == (3, 3, 1.0, 0)
    assert row["short_time_range"] and not row["low_wifi_ratio"]


@pytest.mark.parametrize("kind, good, bad", [
    ("email", "a.b+c@d-e.org", "a@b"), ("url", "https://x.y/z?q", "ftp://x.y"),
    ("mac", "00-1a:2B:3c:4d:5e", "00:11:22:33:44"), ("ipv4", "255.0.10.1", "256.0.0.1"),
    ("iso_timestamp", "2024-02-29T10:00:00.5Z", "2023-02-29"),
])
def test_formats(spark, kind, good, bad):
    df = spark.createDataFrame([(good,), (bad,), (None,)], "v string")
    row = quality.format_profile(df, {"v": kind}).first()
    assert (row["valid"], row["invalid"], row["absent"]) == (1, 1, 1)


def test_file_checks(spark):
    df = spark.createDataFrame([("a/b.JSON", 5), ("a/.json", 3 << 20), ("c.tar.gz", 0)], "n string, s long")
    got = df.select(formats.has_extension(F.col("n"), ["json", ".gz"]), formats.fits_size(F.col("s"), 1)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, True)]


def write_texts(spark, *bodies):
    """One file per body."""
    path = run_dir(spark, "texts")
    rows = [(f"d{i}", b) for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "name string, value string").write.partitionBy("name").text(path)
    return path


def test_reading_exports(spark):
    body = {"export_metadata": GOOD_META, "data": [record(), record(message="ABSENT", structured_data={"ssid": "x", "channel": 6})]}
    path = write_texts(spark, json.dumps(body))
    rows = exports.read_export(spark, path).orderBy("record_idx").collect()
    assert [(r["record_idx"], r["message"]) for r in rows] == [(0, "m"), (1, None)]
    assert rows[1]["structured_data"] == {"ssid": "x", "channel": "6"}
    info = exports.export_info(spark, path).first()
    assert (info["record_count"], info["has_metadata"], info["total_records"]) == (2, True, 100)
    headless = write_texts(spark, json.dumps({"export_metadata": GOOD_META}))
    assert exports.read_export(spark, headless, require_data=False).count() == 0
    with pytest.raises(Exception, match="no data section"):
        exports.read_export(spark, headless).collect()


def test_catalog_and_findings(spark):
    path = write_texts(spark, "{}", "{broken")
    rows = files.export_catalog(spark, path, "*.txt").collect()
    assert len(rows) == 2 and all(len(r["sha256"]) == 64 for r in rows)
    found_rows = files.storage_findings(spark, f"{path}/none", path, f"{path}/none")
    assert [r["finding"] for r in found_rows.filter("area = 'exports'").collect()] == ["invalid_json"]
    stats = {r["area"]: r["files"] for r in files.storage_stats(spark, {"a": path, "b": f"{path}/none"}).collect()}
    assert stats == {"a": 2 + 1, "total": 2 + 1} or stats == {"a": 2, "total": 2}
    now = F.current_timestamp()
    listing = files.listing(spark, path)
    assert files.retention_candidates(listing, now, 1).count() == 0
    assert files.retention_candidates(listing, now, -1).count() == listing.count()


def test_service_logs(spark):
    lines = [
        json.dumps({"timestamp": "2024-01-01T00:00:00", "level": "INFO", "logger": "x", "message": "Progress 12.5% of TRAINING_ID: Job_7", "step": "fit"}),
        json.dumps({"level": "INFO", "message": "model", "training_id": "t9", "progress": 40, "training": {"a": 1}}),
        "", "not json", json.dumps({"message": "GET /", "logger": "http"}), "[1, 2]",
    ]
    path = run_dir(spark, "service")
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(path)
    rows = log_source.read_service_logs(spark, path)
    assert rows.count() == 3
    got = {r["message"]: r for r in la.job_logs(rows).collect()}
    assert len(got) == 2
    first = got["Progress 12.5% of TRAINING_ID: Job_7"]
    assert (first["training_id"], first["progress"], first["step"]) == ("job_7", 12.5, "fit")
    second = got["model"]
    assert (second["training_id"], second["progress"]) == ("t9", 40.0) and "training" in second["extra"]
    assert second["log_ts"] is None


def test_day_folders_are_pruned(spark, sf_dir):
    from checks.views import logs

    path = run_dir(spark, "logs")
    log_source.write_logs(logs(spark, sf_dir), path)
    table = log_source.read_logs(spark, path)
    found_rows = la.search(table, start="2024-01-10 00:00:00", end="2024-01-11 12:00:00")
    plan = found_rows._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "log_date" in filters and ">=" in filters and "<=" in filters
    days = {r["log_date"].day for r in found_rows.select("log_date").distinct().collect()}
    assert days == {10, 11}


def test_listings_have_empty_files(spark):
    """Spark's scans pass over files without bytes; listings, totals and findings do not."""
    path = run_dir(spark, "listed")
    for name in ("a b.log", "c%20d.log"):
        empty = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/x/{name}")
        empty.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(empty).close()
    spark.range(1).select(F.lit("x").alias("value")).coalesce(1).write.text(f"{path}/full")
    rows = files.listing(spark, path).collect()
    assert sorted(r.length for r in rows) == [0, 0, 2] and all(r.modificationTime is not None for r in rows)
    found = files.storage_findings(spark, run_dir(spark, "none"), run_dir(spark, "none"), path).collect()
    assert [(r.area, r.finding) for r in found] == [("logs", "empty_log")] * 2


def test_documents_are_written_record_by_record(spark):
    path = run_dir(spark, "documents")
    rows = spark.range(300).select(F.pmod("id", F.lit(2)).alias("file"), (-F.col("id")).alias("at"), F.concat(F.lit('"}],'), "id").alias("message"),
                                   F.when(F.col("id") > 9, "p").alias("process_name"))
    exports.write_export(rows, path, "file", "at", "2024-02-01T00:00:00Z")
    lines = spark.read.text(path)
    assert lines.count() == 300 and lines.agg(F.max(F.length("value"))).first()[0] < 200  # no line holds a document
    read = exports.read_export(spark, path).orderBy("file", "record_idx").collect()
    assert [r.message for r in read] == [f'"}}],{k}' for k in [*range(298, -1, -2), *range(299, 0, -2)]]
    info = exports.export_info(spark, path).collect()
    assert {(r.record_count, r.total_records, r.format, r.has_metadata) for r in info} == {(150, 150, "json", True)}


def test_whole_documents_share_folders(spark, sf_dir):
    """Writing and listing go by folders of many documents, not by one for each."""
    from checks import source_checks

    read = exports.read_documents(spark, source_checks._faulty(spark, sf_dir)).collect()
    assert len(read) == 20 and len({r.file.rsplit("/", 1)[0] for r in read}) == 1
    assert {r.file.rsplit("/", 1)[1] for r in read} == {f"doc={k}.json" for k in range(20)}
    assert all(r.body.endswith("\n") and r.size_bytes == len(r.body.encode()) for r in read)


def test_whole_documents_are_written_as_they_are(spark):
    path = run_dir(spark, "whole")
    bodies = {"a/1.json": '{"x":"é\n"}', "a/2 %20.json": "no end", "3.json": ""}
    docs = spark.createDataFrame([*bodies.items(), ("b/4.json", None)], "name string, body string")
    exports.write_documents(docs, path)
    read = {r.file.split("/whole-")[1].split("/", 1)[1]: r.body for r in exports.read_documents(spark, path).collect()}
    assert sorted(read.values()) == sorted(b for b in bodies.values() if b)  # Spark's scans pass over files without bytes
    assert {r.path.rsplit("/", 1)[1]: r.length for r in files.listing(spark, path).collect()} == {
        "1.json": 11, "2 %20.json": 6, "3.json": 0, "4.json": 0}
    with pytest.raises(FileExistsError):
        exports.write_documents(docs, path)


def test_a_failed_write_leaves_no_documents(spark, tmp_path):
    docs = spark.range(40).select(F.concat("id", F.lit(".json")).alias("name"), F.when(
        F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise(F.lit("{}")).alias("body"))
    with pytest.raises(Exception, match="stop"):
        exports.write_documents(docs, f"{tmp_path}/failed")
    assert not list(tmp_path.iterdir())
