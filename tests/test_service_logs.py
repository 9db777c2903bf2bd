"""Searches of stored service logs are pruned by day and level."""

import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logprism.operators import loganalytics as la
from logprism.session import run_dir
from logprism.sources import logs as source


def test_search_prunes_days_and_pushes_the_level(spark):
    lines = [(f'{{"timestamp": "2024-01-{d:02d}T10:00:00", "level": "{level}", "message": "m {d}"}}',)
             for d in range(1, 6) for level in ("error", "INFO", "Error")] + [('{"message": "no time"}',), ("broken",)]
    rows = source.parse_service_lines(spark.createDataFrame(lines, "value string"))
    path = run_dir(spark, "service")
    source.write_service_logs(rows, path)
    table = spark.read.parquet(path)
    assert table.count() == 16
    plain = la.search(rows.withColumn("training_id", F.lit(None).cast("string")), level="error", start="2024-01-02 00:00:00", end="2024-01-03 23:00:00")
    found = la.search(table, level="error", start="2024-01-02 00:00:00", end="2024-01-03 23:00:00")
    assert sorted(r.message for r in found.collect()) == sorted(r.message for r in plain.collect()) == ["m 2", "m 2", "m 3", "m 3"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*log_date", plan)
    assert re.search(r"PushedFilters: \[[^\]]*level_key", plan)  # the rest of the list is cut off


@pytest.mark.parametrize("block", [3, 7, 64 << 10])
def test_last_lines_of_any_bytes(monkeypatch, block):
    """As Python's own reading of lines, whatever ends them and wherever blocks are cut."""
    monkeypatch.setattr(source, "TAIL_BLOCK", block)
    draw = random.Random(block)
    for _ in range(300):
        data = "".join(draw.choice(["a", "é", "", "long line", "\n", "\r\n", "\r", "\n\n"]) for _ in range(draw.randrange(25))).encode()
        lines = io.TextIOWrapper(io.BytesIO(data), encoding="utf-8").read().split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        for n in (1, 2, 5, 40):
            found, size = source.last_lines(pa.BufferReader(data), n)
            assert [line.decode() for line in found] == lines[:-n - 1:-1] and size <= len(data)


def test_tail_reads_the_end_only(spark):
    path = run_dir(spark, "tail")
    lines = spark.range(300_000).select(F.format_string('{"level": "INFO", "message": "line %d"}', "id").alias("value"))
    lines.coalesce(1).write.text(f"{path}/big")
    spark.createDataFrame([("x",), ("",), ('{"level": "ERROR", "message": "m"}',)], "value string").coalesce(1).write.text(f"{path}/small")
    empty = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/empty/service.log")
    empty.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(empty).close()
    rows = source.tail_lines(spark, path, 50).collect()
    big = sorted((r.from_end, r.value) for r in rows if "/big/" in r.file)
    assert big == [(k, f'{{"level": "INFO", "message": "line {300_000 - k}"}}') for k in range(1, 51)]
    assert {r.bytes_read for r in rows if "/big/" in r.file} == {source.TAIL_BLOCK}
    assert len(rows) == 53
    parsed = source.read_service_tail(spark, path, 2).filter("file like '%small%'").collect()
    assert [(r.from_end, r.level) for r in parsed] == [(1, "ERROR")]  # a blank line counts, and gives no row
    with pytest.raises(ValueError):
        source.tail_lines(spark, path, 0)


def test_newest_rows_have_a_fixed_order(spark):
    path = run_dir(spark, "ties")
    spark.createDataFrame([(f'{{"timestamp": "2024-01-01T00:00:00", "message": "m{k}", "x": {k}}}',) for k in range(50)], "value string").repartition(
        7).write.text(path)
    assert sorted(r.message for r in source.read_service_logs(spark, path, newest=5).collect()) == ["m0", "m1", "m10", "m11", "m12"]
