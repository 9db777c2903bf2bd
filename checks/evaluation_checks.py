"""Evaluation of scores; the event value is the score, error events are the anomalies."""

from pyspark.sql import functions as F

from checks.views import scored, with_scored
from logprism.functions import fixed
from logprism.operators import evaluate as ev


def _rounded(df, *plain):
    doubles = {n for n, t in df.dtypes if t == "double"} - set(plain)
    return df.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


def _curve(spark, sf_dir):
    return ev.score_curve(scored(spark, sf_dir))


def _on_curve(operator):
    return lambda spark, sf_dir: _rounded(operator(_curve(spark, sf_dir)))


def _on_scored(operator):
    return lambda spark, sf_dir: _rounded(operator(scored(spark, sf_dir)))


def _stats(spark, sf_dir):
    return ev.score_stats(scored(spark, sf_dir), _curve(spark, sf_dir))


def score_percentiles(spark, sf_dir):
    return _rounded(ev.score_percentiles(_curve(spark, sf_dir), (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)))


def checks_unsupervised(spark, sf_dir):
    return _rounded(ev.unsupervised_checks(_stats(spark, sf_dir)))


def _supervised(spark, sf_dir):
    return ev.supervised_metrics(_curve(spark, sf_dir))


def checks_supervised(spark, sf_dir):
    limits = {**fixed.SUPERVISED_MINIMUMS, "anomaly_ratio": 0.05, "unheard_of": 0.5}
    return _rounded(ev.supervised_checks(_supervised(spark, sf_dir), limits))


def gate_supervised(spark, sf_dir):
    return _rounded(ev.gate(ev.supervised_checks(_supervised(spark, sf_dir)), supervised=True))


def gate_unsupervised(spark, sf_dir):
    return _rounded(ev.gate(ev.unsupervised_checks(_stats(spark, sf_dir)), supervised=False))


def metric_summary(spark, sf_dir):
    metrics = _supervised(spark, sf_dir)
    return _rounded(ev.metric_summary(metrics, ev.supervised_checks(metrics)))


def advice_supervised(spark, sf_dir):
    metrics = _supervised(spark, sf_dir)
    checks = ev.supervised_checks(metrics)
    std = scored(spark, sf_dir).agg(F.stddev_pop("score")).scalar()
    return ev.recommendations(metrics, checks, True, std).select("rule")


def advice_unsupervised(spark, sf_dir):
    metrics = _stats(spark, sf_dir)
    return ev.recommendations(metrics, ev.unsupervised_checks(metrics), False).select("rule")


def stored_model_evaluation(spark, sf_dir):
    """Labels -1 / 1, statistics, percentiles and classification metrics in one row."""
    signed = scored(spark, sf_dir).withColumn("label", F.when(F.col("label") == 1, -1).otherwise(1))
    frame = signed.withColumn("label", ev.from_signed_labels(F.col("label")))
    curve = ev.score_curve(frame)
    metrics = ev.classification_metrics(curve)
    stats = frame.agg(F.count("*").alias("test_samples"), F.avg("score").alias("mean"),
                      F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    wide = ev.score_percentiles(curve, (0.25, 0.5, 0.75, 0.9, 0.95))
    parts = {}
    for frame_ in (metrics, wide):
        row = frame_.select(F.struct(*frame_.columns)).scalar()
        parts |= {c: row.getField(c) for c in frame_.columns}
    return _rounded(stats.withColumns(parts))


QUERIES = {
    "score_threshold": _on_curve(ev.threshold),
    "score_stats": lambda spark, sf_dir: _rounded(_stats(spark, sf_dir)),
    "score_percentiles": score_percentiles,
    "classification_metrics": _on_curve(ev.classification_metrics),
    "classification_metrics_at_30": _on_curve(lambda c: ev.classification_metrics(c, at=30.0)),
    "roc_auc": _on_curve(ev.roc_auc),
    "average_precision": _on_curve(ev.average_precision),
    "confusion": _on_curve(ev.confusion),
    "class_report": _on_curve(ev.class_report),
    "threshold_sweep": _on_curve(ev.threshold_sweep),
    "score_shape": _on_scored(ev.score_shape),
    "class_distribution": _on_scored(ev.class_distribution),
    "checks_unsupervised": checks_unsupervised,
    "checks_supervised": checks_supervised,
    "gate_supervised": gate_supervised,
    "gate_unsupervised": gate_unsupervised,
    "metric_summary": metric_summary,
    "advice_supervised": advice_supervised,
    "advice_unsupervised": advice_unsupervised,
    "stored_model_evaluation": stored_model_evaluation,
}

# --- SQL --------------------------------------------------------------------

_CUT = "cut as (select quantile_cont(score, 0.9) as t from scored)"
_CELLS = """cells as (select cast(sum(case when label = 1 and score > t then 1 else 0 end) as bigint) as tp,
  cast(sum(case when label = 0 and score > t then 1 else 0 end) as bigint) as fp,
  cast(sum(case when label = 1 and score <= t then 1 else 0 end) as bigint) as fn,
  cast(sum(case when label = 0 and score <= t then 1 else 0 end) as bigint) as tn, any_value(t) as t from scored, cut)"""


def _div(a, b):
    return f"coalesce(cast({a} as double) / nullif({b}, 0), 0)"


_RATES = f"""{_div('tp + tn', 'tp + fp + fn + tn')} as accuracy, {_div('tp', 'tp + fp')} as precision,
  {_div('tp', 'tp + fn')} as recall, {_div('2 * tp', '2 * tp + fp + fn')} as f1_score,
  {_div('tp + fp', 'tp + fp + fn + tn')} as anomaly_ratio"""
_METRIC_COLUMNS = ("accuracy", "precision", "recall", "f1_score", "anomaly_ratio")
_AUC = """auc as (select sum(case when label = 1 then r else 0 end) as s, sum(label) as p, count(*) as n from
  (select label, (rank() over (order by score) + rank() over (order by score) + count(*) over (partition by score) - 1) / 2.0 as r from scored)),
  auc_value as (select (s - p * (p + 1) / 2.0) / (p * cast(n - p as double)) as roc_auc from auc)"""
_AP = """steps as (select score, sum(label) as pos, count(*) as n from scored group by 1),
  walk as (select pos, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as k, sum(pos) over () as p from steps),
  ap_value as (select sum(cast(pos as double) / p * tp / k) as average_precision from walk)"""
_METRICS = f"metrics as (select {_RATES}, t as threshold_value, roc_auc, average_precision from cells, auc_value, ap_value)"
_STATS = """stats as (select avg(score) as score_mean, stddev_pop(score) as score_std, min(score) as score_min, max(score) as score_max,
  avg(case when score > t then 1.0 else 0.0 end) as anomaly_ratio, any_value(t) as threshold_value from scored, cut)"""


def _round(names):
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def _supervised_rows(limits, known=(*_METRIC_COLUMNS, "roc_auc", "average_precision")):
    rows = [
        f"select '{m}' as \"check\", cast({m if m in known else 'null'} as double) as value, cast({v} as double) as threshold, "
        + (f"coalesce({m} >= {v}, false)" if m in known else "true") + " as passed from metrics"
        for m, v in limits.items()
    ]
    return " union all ".join(rows)


_UNSUPERVISED_ROWS = " union all ".join([
    "select 'score_std' as \"check\", score_std as value, cast(0.01 as double) as threshold, score_std >= 0.01 as passed from stats",
    "select 'anomaly_ratio', anomaly_ratio, 0.15, anomaly_ratio <= 0.15 from stats",
    "select 'score_mean', score_mean, -1.0, score_mean >= -1.0 from stats",
    "select 'score_distribution', score_std, 0.01, score_std > 0.01 from stats",
])
_GATE = """select count(*) as total_checks, count(*) filter (where passed) as passed_checks,
  round(avg(case when passed then 1.0 else 0.0 end), 6) as pass_rate, {verdict} as accepted from checks"""
_SUPERVISED_CHECKS = f"checks as ({_supervised_rows(fixed.SUPERVISED_MINIMUMS)})"
_ALL = (_CUT, _CELLS, _AUC, _AP, _METRICS)
_LONG_METRICS = "long as (" + " union all ".join(
    f"select '{m}' as metric, {m} as value from metrics where {m} is not null"
    for m in (*_METRIC_COLUMNS, "threshold_value", "roc_auc", "average_precision")) + ")"
_PERCENT = (25, 50, 75, 90, 95, 99)

SQL = {
    "score_threshold": with_scored("select round(t, 6) as threshold from cut", _CUT),
    "score_stats": with_scored(f"select {_round(('score_mean', 'score_std', 'score_min', 'score_max', 'anomaly_ratio', 'threshold_value'))} from stats", _CUT, _STATS),
    "score_percentiles": with_scored("select " + ", ".join(
        f"round(quantile_cont(score, {p / 100}), 6) as p{p}" for p in _PERCENT) + " from scored"),
    "classification_metrics": with_scored(f"select {_round(_METRIC_COLUMNS)}, round(threshold, 6) as threshold from (select {_RATES}, t as threshold from cells)", _CUT, _CELLS),
    "classification_metrics_at_30": with_scored(f"select {_round(_METRIC_COLUMNS)}, threshold from (select {_RATES}, t as threshold from cells)",
                                                "cut as (select cast(30.0 as double) as t)", _CELLS),
    "roc_auc": with_scored("select round(roc_auc, 6) as roc_auc from auc_value", _AUC),
    "average_precision": with_scored("select round(average_precision, 6) as average_precision from ap_value", _AP),
    "confusion": with_scored("""select 0 as label, 0 as predicted, tn as n from cells union all select 0, 1, fp from cells
        union all select 1, 0, fn from cells union all select 1, 1, tp from cells""", _CUT, _CELLS),
    "class_report": with_scored(f"""select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1_score, 6) as f1_score, support from (
        select * from per_class
        union all select 'macro avg', avg(precision), avg(recall), avg(f1_score), cast(sum(support) as bigint) from per_class
        union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1_score * support) / sum(support), cast(sum(support) as bigint) from per_class)""", _CUT, _CELLS,
        f"""per_class as (select '1' as class, {_div('tp', 'tp + fp')} as precision, {_div('tp', 'tp + fn')} as recall,
          {_div('2 * tp', '2 * tp + fp + fn')} as f1_score, tp + fn as support from cells
          union all select '0', {_div('tn', 'tn + fn')}, {_div('tn', 'tn + fp')}, {_div('2 * tn', '2 * tn + fp + fn')}, tn + fp from cells)"""),
    "threshold_sweep": with_scored(f"""select percentile, round(threshold, 6) as threshold, {_round(_METRIC_COLUMNS[1:])} from
        (select percentile, t as threshold, {_RATES} from cells)""",
        "cuts as (" + " union all ".join(f"select {round(q * 100)} as percentile, quantile_cont(score, {q}) as t from scored" for q in fixed.SWEEP_QUANTILES) + ")",
        """cells as (select percentile, any_value(t) as t, count(*) filter (where label = 1 and score > t) as tp, count(*) filter (where label = 0 and score > t) as fp,
          count(*) filter (where label = 1 and score <= t) as fn, count(*) filter (where label = 0 and score <= t) as tn from scored, cuts group by 1)"""),
    "score_shape": with_scored("""select round(corr(label, score), 6) as score_correlation,
        round(avg(case when label = 1 then score end) - avg(case when label = 0 then score end), 6) as score_separation,
        round(var_pop(score), 6) as score_variance,
        round(avg(power((score - m) / s, 3)), 6) as score_skewness
        from scored, (select avg(score) as m, stddev_pop(score) as s from scored)"""),
    "class_distribution": with_scored("""select count(*) filter (where label = 1) as detected_anomalies, count(*) as total_samples,
        round(avg(cast(label as double)), 6) as anomaly_ratio,
        round(coalesce(avg(score) filter (where label = 0), 0), 6) as normal_mean, round(coalesce(avg(score) filter (where label = 1), 0), 6) as anomaly_mean,
        round(coalesce(stddev_pop(score) filter (where label = 0), 0), 6) as normal_std, round(coalesce(stddev_pop(score) filter (where label = 1), 0), 6) as anomaly_std
        from scored"""),
    "checks_unsupervised": with_scored(f'select "check", round(value, 6) as value, threshold, passed from ({_UNSUPERVISED_ROWS})', _CUT, _STATS),
    "checks_supervised": with_scored('select "check", round(value, 6) as value, threshold, passed from ('
        + _supervised_rows({**fixed.SUPERVISED_MINIMUMS, "anomaly_ratio": 0.05, "unheard_of": 0.5}) + ")", *_ALL),
    "gate_supervised": with_scored(_GATE.format(verdict="""bool_and(passed) filter (where "check" in ('accuracy', 'precision', 'recall', 'f1_score'))
        and coalesce(max(value) filter (where "check" = 'roc_auc') >= 0.5, true)"""), *_ALL, _SUPERVISED_CHECKS),
    "gate_unsupervised": with_scored(_GATE.format(verdict="avg(case when passed then 1.0 else 0.0 end) >= 0.5"), _CUT, _STATS, f"checks as ({_UNSUPERVISED_ROWS})"),
    "metric_summary": with_scored("""select count(*) filter (where passed) as passed_thresholds, count(*) as total_thresholds,
        round(avg(case when passed then 1.0 else 0.0 end), 6) as threshold_pass_rate,
        (select arg_max(metric, value) from long) as best_metric, (select round(max(value), 6) from long) as best_value,
        (select arg_min(metric, value) from long) as worst_metric, (select round(min(value), 6) from long) as worst_value from checks""",
        *_ALL, _SUPERVISED_CHECKS, _LONG_METRICS),
    "advice_supervised": with_scored("""select 'low_precision' as rule from metrics where precision < 0.7
        union all select 'low_recall' from metrics where recall < 0.7 union all select 'low_f1' from metrics where f1_score < 0.7
        union all select 'low_auc' from metrics where roc_auc < 0.8
        union all select 'retrain' from (select avg(case when passed then 1.0 else 0.0 end) as rate from checks) where rate < 0.5
        union all select 'flat_scores' from (select stddev_pop(score) as s from scored) where s < 0.1""", *_ALL, _SUPERVISED_CHECKS),
    "advice_unsupervised": with_scored(f"""select 'flat_scores' as rule from stats where score_std < 0.1
        union all select 'too_sensitive' from stats where anomaly_ratio > 0.1 union all select 'too_strict' from stats where anomaly_ratio < 0.01
        union all select 'retrain' from (select avg(case when passed then 1.0 else 0.0 end) as rate from ({_UNSUPERVISED_ROWS})) where rate < 0.6""", _CUT, _STATS),
    "stored_model_evaluation": with_scored(f"""select {_round(_METRIC_COLUMNS)}, round(t, 6) as threshold,
        (select count(*) from scored) as test_samples, (select round(avg(score), 6) from scored) as mean, (select round(stddev_pop(score), 6) from scored) as std,
        (select min(score) from scored) as min, (select max(score) from scored) as max, """
        + ", ".join(f"(select round(quantile_cont(score, {p / 100}), 6) from scored) as p{p}" for p in (25, 50, 75, 90, 95))
        + f" from (select {_RATES}, t from cells)", _CUT, _CELLS),
}
