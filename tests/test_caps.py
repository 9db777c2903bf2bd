"""Nothing is cut off or switched by size."""

import pytest
from pyspark.sql import functions as F

from logprism.functions.formats import parse_iso
from logprism.operators import forest, registry, summary
from logprism.plans import training


@pytest.mark.parametrize("rows,size", [(257, 256), (411, 256), (450, 256), (2000, 256), (2000, 8), (300, 8), (5, 256), (20000, 16)])
def test_every_tree_gets_its_rows(spark, rows, size):
    picked = forest.sample_rows(spark.range(rows).withColumnRenamed("id", "r"), "r", rows, 40, size, 42)
    counts = picked.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("r").alias("d")).collect()
    assert len(counts) == 40 and {(c.n, c.d) for c in counts} == {(min(rows, size),) * 2}


def test_the_cut_does_not_change_the_sample(spark, monkeypatch):
    frame = spark.range(3000).withColumnRenamed("id", "r")

    def sample():
        return {(r.tree, r.r, r._rank) for r in forest.sample_rows(frame, "r", 3000, 10, 64, 1).collect()}

    usual = sample()
    for spare in (-7.9, 1000.0):  # far too few candidates at first, and all rows
        monkeypatch.setattr(forest, "SPARE_DEVIATIONS", spare)
        assert sample() == usual


def test_versions_of_any_length(spark):
    def latest(*versions):
        frame = spark.createDataFrame([(v, 1) for v in versions], "version string, size_bytes long")
        return registry.storage_and_version(frame).first()["latest_version"]

    long = "1.2.3.4.5.6.7.8."
    assert latest(long + "1", long + "20", long + "3") == long + "20"
    assert latest("1.2", "1.2.0.0", "1.1.9") in ("1.2", "1.2.0.0")
    assert latest("1.10.0", "1.9.9", "1.9.9.9.9.9.9.9.9.9") == "1.10.0"
    assert latest("99999999999999999999999.1", "5") == "99999999999999999999999.1"


@pytest.mark.parametrize("text,wanted", [
    ("2024-01-01T00:00:00.123456789", "2024-01-01 00:00:00.123456"), ("20240101T100000", "2024-01-01 10:00:00"),
    ("2024-01-01T10", "2024-01-01 10:00:00"), ("2024-01-01T10:00:00+02", "2024-01-01 08:00:00"),
    ("2024-01-01", "2024-01-01 00:00:00"), ("20240101", "2024-01-01 00:00:00"), ("2024-01-01 10:30Z", "2024-01-01 10:30:00"),
    ("2024-01-01T10:00:00,5-0130", "2024-01-01 11:30:00.5"), ("2024-0101", None), ("2024", None), ("10:00", None),
    ("2024-13-01", None), ("2024-01-01T25:00:00", None), ("2024-01-01T10:0000", None), ("", None), (None, None),
])
def test_iso_forms(spark, text, wanted):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(parse_iso(F.col("t")).cast("string")).first()[0] == wanted


def test_hostile_numbers_do_not_stop_the_summary(spark):
    rows = [("d", "2024-01-01 00:00:00", "INFO", f"signal={n}") for n in ("-9999999999", "9223372036854775807", "-50", "9" * 40)]
    frame = spark.createDataFrame(rows, "device string, t string, level string, message string")
    numbers = frame.select(*[summary._number(F.col("message"), "signal=(-?[0-9]+)").alias("n")])
    assert numbers.agg(F.sum(F.col("n") * F.col("n"))).first()[0] > 1e37


def test_importance_uses_all_records_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(training, "SHUFFLE_BLOCK", 50)
    points = spark.range(400).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("a"), F.lit(1.0).alias("b"))
    model = training.fit_features(points, ("a", "b"), "id", "v")
    got = {r["feature"]: r["importance"] for r in training.permutation_importance(points, model, "id", repeats=2).collect()}
    assert got["a"] > 0 and got["b"] == 0


def test_importance_sends_each_row_once_and_joins_nothing(spark):
    points = spark.range(400).select("id", *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000.0).alias(c) for c in "ab"])
    model = training.fit_features(points, ("a", "b"), "id", "v")
    plan = training.permutation_importance(points, model, "id", repeats=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("explode(") == 1  # the repeats only, not the features


def test_folds_need_unique_ids(spark):
    frame = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    with pytest.raises(ValueError):
        training.assign_folds(frame, "id")
