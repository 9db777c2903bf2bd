"""Fit, evaluate, gate and store an anomaly model."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.operators import evaluate as ev
from logprism.operators import forest as forest_ops
from logprism.operators.distribution import distribution, percentiles
from logprism.operators.lof import local_outlier_factor
from logprism.operators.ordered import ranged_running_sum
from logprism.operators.scaling import Scaler
from logprism.plans.features import extract_features, feature_names
from logprism.plans.scoring import score_features
from logprism.session import store
from logprism.sources.model_store import Model, build_metadata, save_model


#: Records of one block of a shuffle, at about the most.
SHUFFLE_BLOCK = 4096


@dataclass(frozen=True)
class Options:
    """Options of a training run."""

    model_type: str = "isolation_forest"
    trees: int = fixed.TREES
    sample: int = fixed.SAMPLE_PER_TREE
    neighbours: int = fixed.NEIGHBOURS
    contamination: float | str = fixed.CONTAMINATION
    seed: int = fixed.SEED
    all_medians: bool = False


class Rejected(ValueError):
    """The model does not meet the requirements."""


def fit_features(
    features: DataFrame, names: Sequence[str], record_id: str, version: str,
    options: Options = Options(),
) -> Model:
    """Scaler, forest and cut from a feature frame.  The frame should be stored or cached."""
    if options.model_type == "local_outlier_factor":
        raise ValueError("local_outlier_factor scores the rows it is fitted on: use train or score_outlier_factor")
    if options.model_type != "isolation_forest":
        raise ValueError(f"unsupported model type {options.model_type!r}")
    scaler = Scaler.fit(features, names, options.all_medians)
    ready = scaler.transform(scaler.fill(features)).select(record_id, *names)
    nodes = forest_ops.fit_forest(
        ready, names, record_id, scaler.rows, options.trees, options.sample, options.seed)
    # the node table is small; storing it keeps the trees the same in every later job
    nodes = store(nodes.coalesce(1), "nodes")
    if options.contamination == "auto":
        offset = -0.5
    else:
        scored = forest_ops.forest_score(ready, forest_ops.Forest.from_nodes(nodes, names))
        normality = scored.select((-F.col("anomaly_score")).alias("value"))
        cut = percentiles(distribution(normality, "value"), "value", {"cut": float(options.contamination)})
        offset = cut.first()["cut"]
    return Model(version, scaler, nodes, offset)


def score_outlier_factor(
    features: DataFrame, names: Sequence[str], record_id: str, options: Options = Options(),
) -> tuple[Scaler, DataFrame, float]:
    """Scaler, scored rows and cut of the second model type, which scores the rows it is fitted on.

    ``anomaly_score`` is the outlier factor, ``decision`` the distance of its
    negative to the cut, ``prediction`` -1 or 1, as for the forest.
    """
    scaler = Scaler.fit(features, names, options.all_medians)
    ready = scaler.transform(scaler.fill(features))
    share = fixed.CONTAMINATION if options.contamination == "auto" else float(options.contamination)
    keep = [c for c in features.columns if c not in names]
    scored = store(local_outlier_factor(
        ready.select(*keep, *names), names, record_id, options.neighbours, share, options.seed
    ).select(*keep, F.col("lof").alias("anomaly_score")), "scored")
    offset = -1.5 if options.contamination == "auto" else percentiles(distribution(
        scored.select((-F.col("anomaly_score")).alias("value")), "value"), "value", {"cut": share}).first()["cut"]
    return scaler, forest_ops.predict(scored, offset), offset


def evaluate_scored(scored: DataFrame, score: str = "anomaly_score", label: str | None = None) -> dict[str, DataFrame]:
    """All evaluation frames of a scored frame.

    Without labels the predictions stand in for them and the metrics are those
    of the score's distribution.
    """
    supervised = label is not None
    y = F.col(label) if supervised else ev.from_signed_labels(F.col("prediction"))
    frame = scored.select(F.col(score).alias("score"), y.cast("int").alias("label"))
    curve = store(ev.score_curve(frame), "curve")
    stats = ev.score_stats(frame, curve)
    metrics = ev.supervised_metrics(curve) if supervised else stats
    checks = ev.supervised_checks(metrics) if supervised else ev.unsupervised_checks(metrics)
    std = stats.select("score_std").scalar()
    return {
        "metrics": metrics, "checks": checks, "gate": ev.gate(checks, supervised),
        "confusion": ev.confusion(curve), "class_report": ev.class_report(curve),
        "threshold_sweep": ev.threshold_sweep(curve),
        "score_stats": stats,
        "score_percentiles": ev.score_percentiles(curve, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)),
        "score_shape": ev.score_shape(frame), "class_distribution": ev.class_distribution(frame),
        "summary": ev.metric_summary(metrics, checks),
        "recommendations": ev.recommendations(metrics, checks, supervised, std),
    }


def train(
    spark: SparkSession, logs: DataFrame, record_id: str, version: str, created_at: str,
    root: str | None = None, options: Options = Options(), label: str | None = None,
    export_file: str | None = None, training_id: str | None = None, require: bool = True,
    export_size: int | None = None, folds: int | None = None, importance: bool = False,
) -> tuple[Model, dict[str, DataFrame], DataFrame]:
    """Features, fit, evaluation, gate and (with ``root``) storage.

    Returns the model, the evaluation frames and the one-row report.  The
    features are written once to the shared folder, so that a lost executor
    costs a re-read and not the windows again.  ``folds`` asks for cross
    validation of a forest (against the label, or its own predictions),
    ``importance`` for the importance of its features; both go to the metadata
    with the size of the export and the duration.  An outlier-factor model has
    no nodes; it describes the rows it was fitted on and is not stored.
    """
    started = time.monotonic()
    if options.model_type not in ("isolation_forest", "local_outlier_factor"):
        raise ValueError(f"unsupported model type {options.model_type!r}")
    is_forest = options.model_type == "isolation_forest"
    if not is_forest and (root is not None or folds or importance):
        raise ValueError("only forests are stored, cross-validated or asked for importance")
    names = feature_names()
    keep = [record_id] + ([label] if label else [])
    features = store(extract_features(logs, keep=keep).select(*keep, *names), "features")
    if is_forest:
        model = fit_features(features, names, record_id, version, options)
        scored = store(score_features(features, model), "scored")
    else:
        scaler, scored, offset = score_outlier_factor(features, names, record_id, options)
        model = Model(version, scaler, None, offset)
    frames = evaluate_scored(scored, label=label)
    frames["scored"] = scored
    verdict = frames["gate"].first()
    if require and not verdict["accepted"]:
        raise Rejected("the model does not meet the requirements")
    metrics = frames["metrics"].first().asDict()
    spread = {**frames["score_percentiles"].first().asDict(), **frames["score_stats"].first().asDict()}
    cv_score = weights = None
    if folds:
        truth = features if label else features.join(
            scored.select(record_id, ev.from_signed_labels(F.col("prediction")).alias("_label")), record_id)
        cv_score = cross_validation_summary(cross_validate(
            truth, names, record_id, label or "_label", options, folds)).first()["mean_cv_score"]
    if importance:
        weights = {r["feature"]: r["importance"] for r in permutation_importance(features, model, record_id).collect()}
    duration = time.monotonic() - started
    metadata = build_metadata(
        version, created_at, options.model_type, model.scaler.rows, names, asdict(options), metrics,
        spread, (verdict["passed_checks"], verdict["total_checks"]), export_file, training_id,
        export_size, duration, cv_score, weights)
    model = Model(model.version, model.scaler, model.nodes, model.offset, metadata)
    if root is not None:
        save_model(spark, model, root)
    return model, frames, training_report(model, frames, options.model_type, duration)


def training_report(
    model: Model, frames: dict[str, DataFrame], model_type: str, duration: float | None = None,
) -> DataFrame:
    """One row: status, model, number of samples and features, duration, metrics, checks, advice."""
    metrics = frames["metrics"]
    values = F.map_from_arrays(
        F.array(*[F.lit(c) for c in metrics.columns]),
        F.array(*[F.col(c).cast("double") for c in metrics.columns]),
    )
    checks = frames["checks"].agg(F.map_from_entries(F.collect_list(F.struct("check", "passed"))))
    advice = frames["recommendations"].agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "advice"))), lambda r: r["advice"]))
    return metrics.select(
        F.lit("completed").alias("status"), F.lit(model.version).alias("version"),
        F.lit(model_type).alias("model_type"), F.lit(model.scaler.rows).cast("long").alias("training_samples"),
        F.lit(len(model.scaler.features)).alias("feature_count"),
        F.lit(duration).cast("double").alias("training_duration"),
        F.array(*[F.lit(f) for f in model.scaler.features]).alias("feature_names"),
        values.alias("metrics"), checks.scalar().alias("checks"), advice.scalar().alias("recommendations"),
    )


# --- cross validation and importance -------------------------------------------

def assign_folds(df: DataFrame, order: str, folds: int = fixed.CV_FOLDS) -> DataFrame:
    """Contiguous folds of record order whose sizes differ by at most one (larger ones first)."""
    ranks = ranged_running_sum(
        df.select(order).withColumn("_one", F.lit(1).cast("long")), order, ["_one"])
    position, total = F.col("cum__one") - 1, F.col("total__one")
    small = F.floor(total / folds)
    big = F.pmod(total, F.lit(folds))
    edge = big * (small + 1)
    fold = F.when(position < edge, F.floor(position / (small + 1))).otherwise(
        big + F.floor((position - edge) / F.greatest(small, F.lit(1))))
    counted = df.agg(F.count("*").alias("rows"), F.count_distinct(order).alias("different")).first()
    if counted["different"] < counted["rows"]:
        raise ValueError(f"{order} must be unique and never null to assign folds by it")
    return df.join(ranks.select(order, fold.cast("int").alias("fold")), order)


def cross_validate(
    features: DataFrame, names: Sequence[str], record_id: str, label: Column | str,
    options: Options = Options(), folds: int = fixed.CV_FOLDS,
) -> DataFrame:
    """Per fold: negative mean squared difference of prediction and label.

    ``cv_neg_mse`` compares the predictions -1 / 1 with the labels 0 / 1 as
    they are; ``cv_neg_mse_matched`` maps the predictions to 1 / 0 first.
    """
    truth = F.col(label) if isinstance(label, str) else label
    table = store(assign_folds(features.withColumn("_y", truth), record_id, folds), "folds")
    out = None
    for fold in range(folds):  # one fit per fold; the number is an option
        model = fit_features(table.filter(F.col("fold") != fold), names, record_id, f"fold-{fold}", options)
        scored = score_features(table.filter(F.col("fold") == fold), model, stats="batch")
        p, y = F.col("prediction"), F.col("_y")
        row = scored.groupBy("fold").agg(
            F.count("*").alias("rows"),
            (-F.avg((p - y) * (p - y))).alias("cv_neg_mse"),
            (-F.avg(F.pow(ev.from_signed_labels(p) - y, F.lit(2)))).alias("cv_neg_mse_matched"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(
        F.avg("cv_neg_mse").alias("mean_cv_score"), F.stddev_pop("cv_neg_mse").alias("std_cv_score"),
        F.avg("cv_neg_mse_matched").alias("mean_cv_score_matched"),
    )


def permutation_importance(
    features: DataFrame, model: Model, record_id: str, rows: int | None = None,
    repeats: int = fixed.IMPORTANCE_REPEATS, seed: int = fixed.SEED,
) -> DataFrame:
    """Mean absolute change of the score when one feature is shuffled.

    All records are used unless ``rows`` asks for a sample (the smallest
    hashes).  A shuffle deals the records to random blocks of about
    ``SHUFFLE_BLOCK`` and permutes each, so no window spans a whole repeat.
    Trees are walked again only where a shuffled value takes another way.
    """
    names = model.scaler.features
    ready = model.scaler.transform(model.scaler.fill(features)).select(record_id, *names)
    if rows is not None:
        ready = ready.orderBy(F.xxhash64(F.col(record_id), F.lit(seed)), record_id).limit(rows)
    walker = model.forest()
    sample = store(ready, "importance")
    blocks = max(1, math.ceil(sample.count() / SHUFFLE_BLOCK))
    vector = F.array(*[F.col(n).cast("double") for n in names])
    repeat = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    base = sample.select(F.col(record_id).alias("id"), vector.alias("x"), repeat)
    base = base.withColumns({
        "block": F.pmod(F.xxhash64("id", "repeat", F.lit(seed + 2)), F.lit(blocks)),
        "place": F.xxhash64("id", "repeat", F.lit(seed + 1))})
    shared = features.sparkSession.sparkContext.broadcast(walker)  # bounded by the options

    def changes(block: pa.Table) -> pa.Table:
        """Per feature, the sum of the changes when each row takes it from the row of its place in the second order."""
        x = block["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
        order, second = (x[pc.sort_indices(block, sort_keys=[(c, "ascending") for c in by]).to_numpy()] for by in (("id",), ("place", "id")))
        total = shared.value.shuffle_changes(order, second)
        return pa.table({"f": pa.array(np.arange(len(names)), pa.int32()), "total": total, "rows": np.full(len(names), len(block))})

    # a block is small, and its rows are exploded by feature where they are scored
    both = base.groupBy("repeat", "block").applyInArrow(changes, "f int, total double, rows long")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("f") + 1)
    return both.groupBy("f").agg((F.sum("total") / F.sum("rows")).alias("importance")).select(
        named.alias("feature"), "importance")
