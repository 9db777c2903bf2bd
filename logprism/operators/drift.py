"""Shift of feature distributions between a training and a current frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.operators.distribution import distribution, percentiles

SMALLEST_SHARE = 1e-4


def _long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        [], list(features), "feature", "value")


def _value_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per feature and value: the long form is combined before any shuffle."""
    return _long(df, features).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))


def _shares(counts: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Rows per training bucket; the edges are one row per feature."""
    bucket = F.size(F.filter("edges", lambda e: e < F.col("value")))
    return counts.join(edges, "feature").groupBy("feature", bucket.alias("bucket")).agg(F.sum("n").alias(name))


def drift_report(
    train: DataFrame, current: DataFrame, features: Sequence[str], buckets: int = 10,
    threshold: float = fixed.DRIFT_THRESHOLD,
) -> DataFrame:
    """Population stability index per feature, and whether it passes the threshold.

    Bucket edges are the exact training quantiles; an empty bucket counts as a
    share of 0.0001.
    """
    names = [f"q{i}" for i in range(1, buckets)]
    spread = distribution(_long(train, features), "value", keys=["feature"])
    base = spread.select("feature", "value", "n")
    cuts = percentiles(
        spread, "value", {n: (i + 1) / buckets for i, n in enumerate(names)}, ["feature"])
    edges = cuts.select("feature", F.array_distinct(F.array(*names)).alias("edges"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bucket"))
    both = (
        grid.join(_shares(base, edges, "a"), ["feature", "bucket"], "left")
        .join(_shares(_value_counts(current, features), edges, "b"), ["feature", "bucket"], "left")
        .fillna(0, ["a", "b"])
    )
    # one small row per feature and bucket from here on
    totals = both.groupBy("feature").agg(F.sum("a").alias("rows_train"), F.sum("b").alias("rows_current"))
    least = F.lit(SMALLEST_SHARE)
    p = F.greatest(F.coalesce(F.try_divide(F.col("a"), F.col("rows_train")), F.lit(0.0)), least)
    q = F.greatest(F.coalesce(F.try_divide(F.col("b"), F.col("rows_current")), F.lit(0.0)), least)
    scored = both.join(totals, "feature").groupBy("feature", "rows_train", "rows_current").agg(
        F.sum((q - p) * F.ln(q / p)).alias("shift"))
    return scored.select(
        "feature", "rows_train", "rows_current", "shift",
        F.lit(float(threshold)).alias("threshold"), (F.col("shift") > threshold).alias("drifted"))
