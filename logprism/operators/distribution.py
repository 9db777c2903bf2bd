"""Value distributions with running totals, and exact percentiles from them.

Spark's ``percentile`` keeps every distinct value of a column in one buffer.
Here the values are counted first (with map-side combine) and the running
totals are built in range pieces, so an exact percentile is two conditional
minimums however many distinct values there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logprism.operators.ordered import ranged_running_sum


def distribution(
    df: DataFrame, value: str, sums: Mapping[str, Column] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per (keys, value): ``n``, the sums, and cum_/total_ columns of each."""
    sums = dict(sums or {})
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n"), *[F.sum(c).cast("long").alias(k) for k, c in sums.items()])
    )
    return ranged_running_sum(counted, value, ["n", *sums], keys)


def percentiles(
    dist: DataFrame, value: str, quantiles: Mapping[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated percentiles, one column per name, one row per key."""
    total = F.max("total_n")
    columns = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("total_n") - 1)
        low = F.min(F.when(F.col("cum_n") > F.floor(position), F.col(value)))
        high = F.min(F.when(F.col("cum_n") > F.ceil(position), F.col(value)))
        exact = F.lit(float(q)) * (total - 1)
        columns.append((low + (high - low) * (exact - F.floor(exact))).alias(name))
    return dist.groupBy(*keys).agg(*columns)


def column_percentiles(df: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Exact percentiles of several numeric columns: one row per column name."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value"
    )
    return percentiles(distribution(long, "value", keys=["feature"]), "value", quantiles, ["feature"])
