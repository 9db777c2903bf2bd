"""Scoring with a fitted model, and what is reported about the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.operators import forest as forest_ops
from logprism.operators.distribution import distribution, percentiles
from logprism.operators.scaling import medians
from logprism.plans.features import extract_features
from logprism.session import store
from logprism.sources.model_store import Model


def score_features(features: DataFrame, model: Model, stats: str = "batch") -> DataFrame:
    """Add anomaly_score, decision and prediction (-1 / 1) to a feature frame.

    Gaps are filled with the medians of this very batch, or with those of the
    training rows when ``stats='training'``.
    """
    if stats not in ("batch", "training"):
        raise ValueError(f"stats must be 'batch' or 'training', not {stats!r}")
    names = model.scaler.features
    missing = [n for n in names if n not in features.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    fills = None
    if stats == "batch":
        counts = features.agg(F.count("*").alias("_rows"), *[F.count(n).alias(n) for n in names]).first()
        fills = medians(features, [n for n in names if counts[n] < counts["_rows"]])
    keep = [c for c in features.columns if c not in names]
    ready = model.scaler.transform(model.scaler.fill(features, fills))
    scored = forest_ops.forest_score(ready.select(*keep, *names), model.forest())
    return forest_ops.predict(scored, model.offset).drop(*names)


def score_logs(logs: DataFrame, model: Model, stats: str = "batch", **columns) -> DataFrame:
    """Features, filling, scaling and scoring of log records.

    Batch medians need a look at the features before scoring, so the features
    are stored once instead of being computed again.
    """
    features = extract_features(logs, **columns)
    if stats == "batch":
        keep = [c for c in logs.columns if c not in model.scaler.features]
        features = store(features.select(*keep, *model.scaler.features), "features")
    return score_features(features, model, stats)


def flag(scored: DataFrame, at: float | None = None, score: str = "anomaly_score",
         quantile: float = fixed.SCORE_QUANTILE) -> DataFrame:
    """Add ``threshold`` and ``flagged`` (0/1): above a given cut or the batch's 90th percentile."""
    if at is None:
        cut = percentiles(distribution(scored, score), score, {"threshold": quantile}).scalar()
    else:
        cut = F.lit(float(at))
    return scored.withColumn("threshold", cut).withColumn(
        "flagged", (F.col(score) > F.col("threshold")).cast("int"))


def flag_summary(flagged: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Totals, share of anomalies, mean and deviation of the score, threshold."""
    return flagged.agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col("flagged") == 0).alias("normal_count"),
        F.count_if(F.col("flagged") == 1).alias("anomaly_count"),
        F.coalesce(F.avg("flagged"), F.lit(0.0)).alias("anomaly_rate"),
        F.avg(score).alias("average_score"), F.stddev_pop(score).alias("score_std"),
        F.max("threshold").alias("threshold"),
    )


def prediction_summary(scored: DataFrame) -> DataFrame:
    """Totals by predicted class, and mean and deviation of the decision value."""
    bad = F.col("prediction") == -1
    return scored.agg(
        F.count("*").alias("total_samples"), F.count_if(~bad).alias("normal_count"),
        F.count_if(bad).alias("anomaly_count"),
        F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)).alias("anomaly_rate"),
        F.avg("decision").alias("mean_decision"), F.stddev_pop("decision").alias("std_decision"),
    )


def show_anomalies(scored: DataFrame, order: str, top: int = 5, anomaly: Column | None = None,
                   by_score: str | None = None, ts: str = "log_ts", process: str = "process_name",
                   message: str = "message") -> DataFrame:
    """The first anomalies in record order, or the highest scores with ``by_score``."""
    rows = scored.filter(F.col("prediction") == -1 if anomaly is None else anomaly)
    ordering = [F.asc(order)] if by_score is None else [F.desc(by_score), F.asc(order)]
    return rows.orderBy(*ordering).limit(top).select(
        order, ts, process, F.substring(message, 1, 100).alias("message_start"))
