"""Evaluation of anomaly scores.

The scored frame (score, label 0/1) is reduced once to a *curve*: one row per
distinct score with counts and running totals.  Thresholds, confusion cells,
ROC AUC, average precision and the threshold sweep are plain aggregations of
the curve, so no operator sorts or re-reads the scored rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.operators.distribution import distribution, percentiles


def score_curve(scored: DataFrame, score: str = "score", label: str | None = "label") -> DataFrame:
    """Counts, positives and their running totals per distinct score."""
    positives = F.col(label).cast("long") if label else F.lit(0).cast("long")
    base = scored.withColumnRenamed(score, "score") if score != "score" else scored
    return distribution(base, "score", {"pos": F.coalesce(positives, F.lit(0))})


def from_signed_labels(label: Column) -> Column:
    """Labels -1 (anomaly) / 1 (normal) to 1 / 0; also makes pseudo-labels of predictions."""
    return (label == -1).cast("int")


def score_percentiles(curve: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """One column p<percent> per quantile."""
    return percentiles(curve, "score", {f"p{round(q * 100)}": q for q in quantiles})


def threshold(curve: DataFrame, quantile: float = fixed.SCORE_QUANTILE) -> DataFrame:
    """One row, column ``threshold``."""
    return percentiles(curve, "score", {"threshold": quantile})


def cells(curve: DataFrame, quantiles: Sequence[float] = (fixed.SCORE_QUANTILE,),
          at: float | None = None) -> DataFrame:
    """Confusion cells for ``score > threshold``: one row per quantile, or one at a given cut."""
    if at is not None:
        cuts = {0.0: F.lit(float(at))}
    else:
        named = {q: f"c{i}" for i, q in enumerate(quantiles)}
        wide = percentiles(curve, "score", {name: q for q, name in named.items()})
        both = wide.select(F.struct(*named.values()).alias("cuts")).scalar()
        cuts = {q: both.getField(name) for q, name in named.items()}
    sums = [F.sum("n").alias("_n"), F.sum("pos").alias("_p")]
    for i, cut in enumerate(cuts.values()):
        above = F.col("score") > cut
        sums += [
            F.sum(F.when(above, F.col("n")).otherwise(0)).alias(f"_n{i}"),
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias(f"_p{i}"),
        ]
    rows = [
        F.struct(
            F.lit(float(q)).alias("quantile"), cut.alias("threshold"),
            F.col(f"_p{i}").alias("tp"), (F.col(f"_n{i}") - F.col(f"_p{i}")).alias("fp"),
            (F.col("_p") - F.col(f"_p{i}")).alias("fn"),
            (F.col("_n") - F.col("_p") - F.col(f"_n{i}") + F.col(f"_p{i}")).alias("tn"),
        )
        for i, (q, cut) in enumerate(cuts.items())
    ]
    return curve.agg(*sums).select(F.inline(F.array(*rows)))


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the divisor is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def _rated(table: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    return table.withColumns({
        "accuracy": _ratio(tp + tn, total), **_rates(tp, fp, fn),
        "anomaly_ratio": _ratio(tp + fp, total),
    })


def classification_metrics(curve: DataFrame, at: float | None = None) -> DataFrame:
    """accuracy, precision, recall, f1_score, anomaly_ratio at the 90th percentile or a cut."""
    return _rated(cells(curve, at=at)).select(
        "accuracy", "precision", "recall", "f1_score", "anomaly_ratio", "threshold"
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area under the ROC curve (ties count half); null with a single class."""
    below = (F.col("cum_n") - F.col("n")) - (F.col("cum_pos") - F.col("pos"))
    tied = F.col("n") - F.col("pos")
    won = F.sum(F.col("pos").cast("double") * (below + tied / 2.0))
    positive, total = F.sum("pos").cast("double"), F.sum("n").cast("double")
    return curve.agg(F.try_divide(won, positive * (total - positive)).alias("roc_auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of recall steps times precision, from the highest score down."""
    found = F.col("total_pos") - F.col("cum_pos") + F.col("pos")
    kept = F.col("total_n") - F.col("cum_n") + F.col("n")
    return curve.agg(
        F.coalesce(
            F.try_divide(F.sum(F.col("pos").cast("double") * found / kept), F.sum("pos").cast("double")),
            F.lit(0.0),
        ).alias("average_precision")
    )


def confusion(curve: DataFrame, at: float | None = None) -> DataFrame:
    """Always four rows: label, predicted, n."""
    cell = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = [
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted"), F.col(c).alias("n"))
        for a, b, c in cell
    ]
    return cells(curve, at=at).select(F.inline(F.array(*rows)))


def class_report(curve: DataFrame, at: float | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    measures = ("precision", "recall", "f1_score")
    table = cells(curve, at=at)
    table = table.withColumns({
        **{f"1_{k}": v for k, v in _rates(tp, fp, fn).items()},
        **{f"0_{k}": v for k, v in _rates(tn, fn, fp).items()},
        "1_support": tp + fn, "0_support": tn + fp,
    })
    total = F.col("0_support") + F.col("1_support")

    def row(name: str, value) -> Column:
        return F.struct(F.lit(name).alias("class"), *[value(m).alias(m) for m in measures],
                        (F.col(f"{name}_support") if name in ("0", "1") else total).alias("support"))

    rows = [
        row("0", lambda m: F.col(f"0_{m}")),
        row("1", lambda m: F.col(f"1_{m}")),
        row("macro avg", lambda m: (F.col(f"0_{m}") + F.col(f"1_{m}")) / 2.0),
        row("weighted avg", lambda m: _ratio(
            F.col(f"0_{m}") * F.col("0_support") + F.col(f"1_{m}") * F.col("1_support"), total)),
    ]
    return table.select(F.inline(F.array(*rows)))


def threshold_sweep(curve: DataFrame, quantiles: Sequence[float] = fixed.SWEEP_QUANTILES) -> DataFrame:
    """Precision, recall, F1 and share of positives at each percentile."""
    return _rated(cells(curve, quantiles)).select(
        F.round(F.col("quantile") * 100).cast("int").alias("percentile"),
        "threshold", "precision", "recall", "f1_score", "anomaly_ratio",
    )


def score_stats(scored: DataFrame, curve: DataFrame, score: str = "score") -> DataFrame:
    """Mean, population deviation, extremes, 90th percentile and share above it."""
    above = cells(curve).select(
        F.struct("threshold", _ratio(F.col("tp") + F.col("fp"),
                 F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("ratio")).alias("cut")
    ).scalar()
    return scored.agg(
        F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
    ).withColumns({
        "anomaly_ratio": above.getField("ratio"), "threshold_value": above.getField("threshold"),
    })


def score_shape(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Correlation with the label, gap of the class means, variance, population skewness."""
    s, y = F.col(score), F.col(label)
    return scored.agg(
        F.corr(y.cast("double"), s).alias("score_correlation"),
        F.coalesce(F.avg(F.when(y == 1, s)) - F.avg(F.when(y == 0, s)), F.lit(0.0)).alias("score_separation"),
        F.var_pop(s).alias("score_variance"),
        F.coalesce(F.nanvl(F.skewness(s), F.lit(0.0)), F.lit(0.0)).alias("score_skewness"),
    )


def class_distribution(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Number and share of anomalies; mean and deviation of the score per class."""
    s, y = F.col(score), F.col(label)
    zero = F.lit(0.0)
    return scored.agg(
        F.count_if(y == 1).alias("detected_anomalies"),
        F.count("*").alias("total_samples"),
        F.avg((y == 1).cast("double")).alias("anomaly_ratio"),
        F.coalesce(F.avg(F.when(y == 0, s)), zero).alias("normal_mean"),
        F.coalesce(F.avg(F.when(y == 1, s)), zero).alias("anomaly_mean"),
        F.coalesce(F.stddev_pop(F.when(y == 0, s)), zero).alias("normal_std"),
        F.coalesce(F.stddev_pop(F.when(y == 1, s)), zero).alias("anomaly_std"),
    )


def supervised_metrics(curve: DataFrame) -> DataFrame:
    """One row: classification metrics with ROC AUC and average precision."""
    return classification_metrics(curve).withColumns({
        "roc_auc": roc_auc(curve).scalar(),
        "average_precision": average_precision(curve).scalar(),
    }).withColumnRenamed("threshold", "threshold_value")


# --- checks over a one-row metrics frame -----------------------------------

def _check(name: str, value: Column, limit: float, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"), value.cast("double").alias("value"),
        F.lit(float(limit)).alias("threshold"), F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def unsupervised_checks(metrics: DataFrame) -> DataFrame:
    """Spread, share of anomalies and mean of the score against their limits."""
    std, ratio, mean = F.col("score_std"), F.col("anomaly_ratio"), F.col("score_mean")
    return metrics.select(F.inline(F.array(
        _check("score_std", std, fixed.MIN_SCORE_STD, std >= fixed.MIN_SCORE_STD),
        _check("anomaly_ratio", ratio, fixed.MAX_ANOMALY_RATIO, ratio <= fixed.MAX_ANOMALY_RATIO),
        _check("score_mean", mean, fixed.MIN_SCORE_MEAN, mean >= fixed.MIN_SCORE_MEAN),
        _check("score_distribution", std, fixed.MIN_SCORE_STD, std > fixed.MIN_SCORE_STD),
    )))


def supervised_checks(metrics: DataFrame, minimums: Mapping[str, float] | None = None) -> DataFrame:
    """Each configured metric against its minimum: null fails, an unknown metric passes."""
    rows = []
    for name, limit in (minimums or fixed.SUPERVISED_MINIMUMS).items():
        known = name in metrics.columns
        value = F.col(name) if known else F.lit(None)
        rows.append(_check(name, value, limit, value >= limit if known else F.lit(True)))
    return metrics.select(F.inline(F.array(*rows)))


def gate(checks: DataFrame, supervised: bool, auc: Column | None = None) -> DataFrame:
    """One row: number of checks, passed checks, pass rate, and the verdict.

    Unsupervised: at least half of the checks pass.  Supervised: the four
    classification checks pass and the AUC, when known, is at least one half.
    """
    rate = F.avg(F.col("passed").cast("double"))
    out = checks.agg(
        F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks"),
        F.coalesce(rate, F.lit(0.0)).alias("pass_rate"),
        F.coalesce(F.bool_and(F.when(
            F.col("check").isin("accuracy", "precision", "recall", "f1_score"), F.col("passed")
        )), F.lit(True)).alias("_four"),
        F.max(F.when(F.col("check") == "roc_auc", F.col("value"))).alias("_auc"),
    )
    known_auc = F.col("_auc") if auc is None else auc
    verdict = (
        F.col("_four") & F.coalesce(known_auc >= fixed.GATE_MIN_AUC, F.lit(True)) if supervised
        else F.col("pass_rate") >= fixed.GATE_PASS_RATE
    )
    return out.withColumn("accepted", verdict).drop("_four", "_auc")


def metric_summary(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """Check totals with the best and the worst known metric."""
    named = metrics.select(*[F.col(c).cast("double").alias(c) for c in metrics.columns])
    long = named.unpivot([], metrics.columns, "metric", "value").filter(F.col("value").isNotNull())
    ends = long.agg(F.struct(
        F.max_by("metric", "value").alias("best_metric"), F.max("value").alias("best_value"),
        F.min_by("metric", "value").alias("worst_metric"), F.min("value").alias("worst_value"),
    ).alias("ends")).scalar()
    totals = gate(checks, supervised=False).select(
        F.col("passed_checks").alias("passed_thresholds"),
        F.col("total_checks").alias("total_thresholds"),
        F.col("pass_rate").alias("threshold_pass_rate"),
    )
    fields = ("best_metric", "best_value", "worst_metric", "worst_value")
    return totals.withColumns({f: ends.getField(f) for f in fields})


ADVICE = {
    "flat_scores": "Scores hardly differ between records; add or change features.",
    "too_sensitive": "More than a tenth of the records are flagged; adjust the contamination.",
    "too_strict": "Fewer than one record in a hundred is flagged; adjust the contamination.",
    "retrain": "Too many checks fail; train again with other options or more varied data.",
    "low_precision": "Many flagged records are normal; adjust the contamination.",
    "low_recall": "Many anomalies are missed; adjust the contamination.",
    "low_f1": "Precision and recall are out of balance; tune the options.",
    "low_auc": "Scores separate the classes poorly; change features or model.",
}


def recommendations(metrics: DataFrame, checks: DataFrame, supervised: bool,
                    score_std: Column | None = None) -> DataFrame:
    """Rows (rule, advice) of the rules that apply to a one-row metrics frame."""
    rate = gate(checks, supervised=False).select("pass_rate").scalar()
    zero = F.lit(0.0)
    if supervised:
        rules = {
            "low_precision": F.coalesce(F.col("precision"), zero) < 0.7,
            "low_recall": F.coalesce(F.col("recall"), zero) < 0.7,
            "low_f1": F.coalesce(F.col("f1_score"), zero) < 0.7,
            "low_auc": F.col("roc_auc") < 0.8,
            "retrain": rate < 0.5,
            "flat_scores": (zero if score_std is None else score_std) < 0.1,
        }
    else:
        rules = {
            "flat_scores": F.col("score_std") < 0.1,
            "too_sensitive": F.col("anomaly_ratio") > 0.1,
            "too_strict": F.col("anomaly_ratio") < 0.01,
            "retrain": rate < 0.6,
        }
    rows = [
        F.struct(F.lit(i).alias("rank"), F.lit(rule).alias("rule"), F.lit(ADVICE[rule]).alias("advice"),
                 F.coalesce(applies, F.lit(False)).alias("_applies"))
        for i, (rule, applies) in enumerate(rules.items())
    ]
    return metrics.select(F.inline(F.array(*rows))).filter("_applies").drop("_applies")
