"""Filling of absent values, and standardisation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.operators.distribution import column_percentiles

_SCALER_SCHEMA = "position int, feature string, median double, mean double, std double, rows long"


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of each column; a column without any value is left out."""
    if not columns:
        return {}
    rows = column_percentiles(df, columns, {"median": 0.5}).collect()  # one row per column
    return {row["feature"]: row["median"] for row in rows}


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill absent numbers with the column's median over this very frame."""
    sparse = _with_nulls(df, columns)
    fills = medians(df, sparse)
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) if c in fills
        else F.col(c).cast("double") for c in columns
    })


def _with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    row = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] < row["_rows"]]


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value (ties: the smallest) as one row; none if all are absent."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(column)).limit(1)
    )


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill absent texts with the most frequent value, or 'unknown' if there is none."""
    return df.withColumns({
        c: F.coalesce(F.col(c), most_frequent(df, c).select(c).scalar(), F.lit("unknown"))
        for c in columns
    })


@dataclass(frozen=True)
class Scaler:
    """Per-feature median, mean and population standard deviation."""

    features: tuple[str, ...]
    median: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    rows: int = 0

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], all_medians: bool = False) -> Scaler:
        """One aggregation for the moments; medians only where values are absent.

        Mean and deviation of the filled column follow from those of the
        present values, the number of gaps, and the median.
        """
        stats = df.agg(
            F.count("*").alias("rows"),
            *[F.count(c).alias(f"n_{c}") for c in features],
            *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features],
        ).first()
        rows = stats["rows"]
        sparse = [c for c in features if stats[f"n_{c}"] < rows]
        median = medians(df, list(features) if all_medians else sparse)
        mean, std = {}, {}
        for c in features:
            n, m, s = stats[f"n_{c}"], stats[f"m_{c}"], stats[f"s_{c}"]
            if not n:  # nothing to learn from: the column stays absent
                mean[c], std[c] = 0.0, 1.0
                continue
            gaps, fill = rows - n, median.get(c, m)
            mean[c] = (n * m + gaps * fill) / rows
            variance = (n * (s * s + (m - mean[c]) ** 2) + gaps * (fill - mean[c]) ** 2) / rows
            std[c] = math.sqrt(variance)
        return Scaler(tuple(features), median, mean, std, rows)

    def fill(self, df: DataFrame, median: dict[str, float] | None = None) -> DataFrame:
        """Fill gaps with the stored medians, or with the ones given."""
        fills = self.median if median is None else median
        return df.withColumns({
            c: F.coalesce(F.col(c).cast("double"), F.lit(fills[c])) if c in fills
            else F.col(c).cast("double") for c in self.features
        })

    def scaled(self, feature: str) -> Column:
        """Standardised column; a constant feature is only centred."""
        spread = self.std[feature] or 1.0
        return (F.col(feature).cast("double") - F.lit(self.mean[feature])) / F.lit(spread)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.features})

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, c, self.median.get(c), self.mean[c], self.std[c], self.rows)
            for i, c in enumerate(self.features)
        ]
        return spark.createDataFrame(rows, _SCALER_SCHEMA)

    @staticmethod
    def from_frame(df: DataFrame) -> Scaler:
        rows = df.orderBy("position").collect()  # one row per feature
        return Scaler(
            tuple(r["feature"] for r in rows),
            {r["feature"]: r["median"] for r in rows if r["median"] is not None},
            {r["feature"]: r["mean"] for r in rows},
            {r["feature"]: r["std"] for r in rows},
            rows[0]["rows"] if rows else 0,
        )


def feature_vector(df: DataFrame, names: Sequence[str], strict: bool = False,
                   output: str = "features") -> DataFrame:
    """Fixed-order ``array<double>``; absent values and columns count as 0.

    In strict mode a missing column is an error.
    """
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise ValueError(f"missing features: {missing}")
    parts = [
        F.lit(0.0) if n in missing else F.coalesce(F.col(n).cast("double"), F.lit(0.0))
        for n in names
    ]
    return df.withColumn(output, F.array(*parts))
