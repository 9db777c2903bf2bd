"""All features of a log in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logprism.functions import features as fx
from logprism.operators.process import process_features
from logprism.operators.windows import WINDOW_FEATURES, CountWhere, DistinctOf, log_measures, trailing_windows
from logprism.session import store

GROUPS = {"time": fx.TIME_FEATURES, "wifi": fx.WIFI_FEATURES, "text": fx.TEXT_FEATURES}


def feature_names(time: bool = True, wifi: bool = True, text: bool = True,
                  windows: bool = True) -> tuple[str, ...]:
    """Names produced by :func:`extract_features` with the same switches."""
    chosen = [n for group, on in (("time", time), ("wifi", wifi), ("text", text)) if on
              for n in GROUPS[group]]
    return (*chosen, *fx.PROCESS_FEATURES, *(WINDOW_FEATURES if windows else ()))


def extract_features(
    logs: DataFrame, ts: str = "log_ts", message: str = "message", process: str = "process_name",
    level: str = "log_level", time: bool = True, wifi: bool = True, text: bool = True,
    windows: bool = True, keep: Sequence[str] | None = None, processes: DataFrame | None = None,
) -> DataFrame:
    """The input columns, or those in ``keep``, plus one numeric column per feature.

    The groups time, wifi and text can be switched off; process and window
    features are always independent of those switches.

    One pass over the logs takes all that comes from the message and stores it
    without the message (unless that is kept); windows, counts and joins then
    read the narrow table only.  ``processes`` gives the table of processes of
    other logs (``process_table``) instead of counting these.
    """
    kept = list(logs.columns if keep is None else keep)
    columns = {"log_level_numeric": fx.level_number(F.col(level))}
    if time:
        columns |= fx.time_features(F.col(ts))
    if wifi:
        columns |= fx.wifi_features(F.col(message))
    if text:
        columns |= fx.text_features(F.col(message))
    helpers = {"_ts": F.col(ts), "_process": F.col(process)}
    measures = {}
    if windows:
        for name, measure in log_measures(message, process).items():
            if isinstance(measure, CountWhere):
                helpers[f"_{name}"] = measure.condition
                measures[name] = CountWhere(F.col(f"_{name}"))
            else:
                helpers[f"_{name}"] = measure.values
                measures[name] = DistinctOf(F.col(f"_{name}"))
    narrow = store(logs.select(
        *[c for c in kept if c not in columns],
        *[c.alias(n) for n, c in columns.items()], *[c.alias(n) for n, c in helpers.items()]), "narrow")
    out = trailing_windows(narrow, "_ts", measures) if windows else narrow
    if processes is None:
        out = process_features(out, "_process")
    else:
        out = out.join(processes.withColumnRenamed(process, "_process"), "_process", "left")
    return out.select(
        *[c for c in kept if c not in columns],
        *(WINDOW_FEATURES if windows else ()), "process_rank", "process_frequency", *columns)
