"""Trailing windows of each record of a stream, exact, by keyed state and event-time timers.

A record's windows [t - w, t] are known when no record of time t or before can
come any more, so records wait until the watermark passes them and leave in the
order of time.  Per key the state is

* ``waiting``: records that the watermark has not passed,
* ``recent``: by minute, what the measures need of the records that have left
  and lie within the widest window before the watermark,
* one event-time timer: at the first waiting record, or when the last recent
  minute runs out, which frees an idle key.

So state is bounded by the widest window and the watermark's delay, and a
restart goes on from the checkpoint; no folder of earlier logs is read.  All
records that are due leave in one sweep over sorted times.

Records behind the watermark are left out (Spark counts them in the progress,
as ``numRowsDroppedByWatermark``), and so are records without a time.  With
input in the order of time, the rows equal those of the table's
``trailing_windows`` for records up to the watermark, however the stream is cut
into batches; input out of order by less than the delay gives the same rows.
Without keys all records share one state and one task: give keys where there
are any.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logprism.functions import fixed
from logprism.operators.windows import MICROS_PER_MINUTE, CountWhere, DistinctOf, log_measures
from logprism.plans.scoring import score_features
from logprism.sources.model_store import Model
from logprism.streaming.streams import STATE_STORE, record_features

#: A carried row is one JSON value in the state; these keep its times exact.
ROW_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
               "ignoreNullFields": "false"}


def window_values(
    at: np.ndarray, counts: np.ndarray, values: list[list[list[str]]], due: np.ndarray, widths: Sequence[int],
) -> list[np.ndarray]:
    """For each width, counts and then distinct values in [t - width, t] of the times ``due``.

    ``at`` is sorted; ``counts`` has a column and ``values[i]`` a list for each
    measure; ``due`` is sorted.
    """
    before = np.vstack([np.zeros((1, counts.shape[1]), np.int64), counts.cumsum(axis=0)])
    kinds = len(values[0]) if values else 0
    out = []
    for width in widths:
        low, high = np.searchsorted(at, due - width, "left"), np.searchsorted(at, due, "right")
        out += list((before[high] - before[low]).T)
        for kind in range(kinds):
            present, first, last, sizes = Counter(), 0, 0, []
            for begin, end in zip(low.tolist(), high.tolist()):
                for k in range(last, end):
                    present.update(values[k][kind])
                for k in range(first, begin):
                    present.subtract(values[k][kind])
                    for value in values[k][kind]:
                        if not present[value]:
                            del present[value]
                first, last = begin, end
                sizes.append(len(present))
            out.append(np.array(sizes, np.int64))
    return out


class TrailingWindows(StatefulProcessor):
    """State of one key.

    Rows begin with the time in microseconds, facts (JSON [counts, lists of
    values]) and the carried row; what they are called is left to Spark.
    """

    def __init__(self, widths: Sequence[int], names: Sequence[str]):
        self.widths, self.names = list(widths), list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, facts string, row string")
        self.recent = handle.getMapState("recent", "minute long", "facts string")
        self.timer = handle.getValueState("timer", "ms long")

    def wake(self, micros: int) -> None:
        """The key's only timer, unless an earlier one is set."""
        ms = -(-micros // 1000)
        if self.timer.exists():
            earlier = self.timer.get()[0]
            if earlier <= ms:
                return
            self.handle.deleteTimer(earlier)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if len(frame):
                at, facts, row = (frame.iloc[:, place] for place in range(3))
                self.waiting.appendList(list(zip(at.tolist(), facts, row)))
                self.wake(int(at.min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in waiting if r[0] <= passed), key=lambda r: r[0])
        later = [r for r in waiting if r[0] > passed]
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        known = {minute: json.loads(facts) for (minute,), (facts,) in self.recent.iterator()}
        stored, touched = set(known), set()
        if due:
            first = due[0][0] - max(self.widths)
            entries = [e for minute in sorted(known) for e in known[minute] if e[0] >= first]
            new = [[at, *json.loads(facts)] for at, facts, _ in due]
            entries = sorted([*entries, *new], key=lambda e: e[0])
            at = np.array([e[0] for e in entries], np.int64)
            counts = np.array([e[1] for e in entries], np.int64).reshape(len(entries), -1)
            times = np.array([r[0] for r in due], np.int64)
            measured = window_values(at, counts, [e[2] for e in entries], times, self.widths)
            yield pd.DataFrame({"_row": [r[2] for r in due], **dict(zip(self.names, measured))})
            for entry in new:
                minute = entry[0] // MICROS_PER_MINUTE
                known.setdefault(minute, []).append(entry)
                touched.add(minute)
        reach = passed - max(self.widths)
        for minute in [m for m in known if (m + 1) * MICROS_PER_MINUTE <= reach]:
            if minute in stored:
                self.recent.removeKey((minute,))
            del known[minute]
        # each is a call to the state store: minutes that no later window reaches are never put there
        for minute in touched & known.keys():
            self.recent.updateValue((minute,), (json.dumps(known[minute]),))
        if later:
            self.wake(min(r[0] for r in later))
        elif known:
            self.wake((max(known) + 1) * MICROS_PER_MINUTE + max(self.widths))


def stream_trailing_windows(
    logs: DataFrame, ts: str, measures: Mapping[str, CountWhere | DistinctOf], minutes: Mapping[str, float] | None = None,
    keys: Sequence[str] = (), delay: str = "10 minutes",
) -> DataFrame:
    """The stream's columns and one column ``<window>_<measure>`` per pair, as ``trailing_windows`` gives them."""
    logs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    minutes = minutes or fixed.WINDOWS
    widths = [int(m * MICROS_PER_MINUTE) for m in minutes.values()]
    counts = [m for m, kind in measures.items() if isinstance(kind, CountWhere)]
    distincts = [m for m, kind in measures.items() if isinstance(kind, DistinctOf)]
    names = [f"{w}_{m}" for w in minutes for m in (*counts, *distincts)]

    facts = F.array(
        F.to_json(F.array(*[F.when(measures[m].condition, 1).otherwise(0) for m in counts])) if counts else F.lit("[]"),
        F.to_json(F.array(*[F.filter(F.coalesce(
            measures[m].values.cast("array<string>"), F.array().cast("array<string>")), lambda v: v.isNotNull())
            for m in distincts])) if distincts else F.lit("[]"))
    carried = F.to_json(F.struct(*logs.columns), ROW_FORMATS)
    rows = logs.withColumn("_ts", F.col(ts).cast("timestamp")).filter("_ts is not null").select(
        F.unix_micros("_ts").alias("_at"), F.concat(F.lit("["), F.array_join(facts, ","), F.lit("]")).alias("_facts"),
        carried.alias("_row"), "_ts", *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *([] if keys else [F.lit(0).alias("_key_0")]))
    found = rows.withWatermark("_ts", delay).groupBy(*[c for c in rows.columns if c.startswith("_key_")]).transformWithStateInPandas(
        statefulProcessor=TrailingWindows(widths, names), outputMode="Append", timeMode="EventTime",
        outputStructType=T.StructType([T.StructField("_row", T.StringType()), *[T.StructField(n, T.LongType()) for n in names]]))
    return found.withColumn("_row", F.from_json("_row", logs.schema, ROW_FORMATS)).select(
        "_row.*", *[f"{w}_{m}" for w in minutes for m in measures])


def stream_window_features(
    logs: DataFrame, ts: str = "log_ts", message: str = "message", process: str = "process_name",
    minutes: Mapping[str, float] | None = None, keys: Sequence[str] = (), delay: str = "10 minutes",
) -> DataFrame:
    """The twelve trailing-window features of a stream of device logs."""
    return stream_trailing_windows(logs, ts, log_measures(message, process), minutes, keys, delay)


def stream_feature_scores(
    logs: DataFrame, model: Model, processes: DataFrame, keys: Sequence[str] = (), delay: str = "10 minutes",
) -> DataFrame:
    """Scores of a stream with all features, windows included; ``processes`` is the table of the fitted logs.

    The model must be fitted with ``all_medians``: gaps are filled with them.
    """
    features = record_features(stream_window_features(logs, keys=keys, delay=delay))
    return score_features(features.join(processes, "process_name", "left"), model, stats="training")
