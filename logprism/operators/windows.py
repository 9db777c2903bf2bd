"""Exact trailing windows: for each row, everything in [t - w, t].

A sliding frame re-reads its window for every row, which is quadratic in dense
logs, and a window without keys runs on one task.  Instead each measure is
written as steps on the time axis and summed up:

* a count rises by c at t and falls by c at t + w + 1 us;
* a distinct value is *present* while any of its occurrences is in the window.
  It rises where an occurrence has no predecessor within w and falls w + 1 us
  after an occurrence without a successor within w.  Dense logs therefore
  give few steps.

The running total of the steps at t is the answer for every row at t.  All
windows and measures share one pass; rows that share t share one table row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.functions.features import mac_addresses, mentions
from logprism.operators.ordered import neighbours, running_sum
from logprism.session import store

MICROS_PER_MINUTE = 60_000_000
_SEEN = "_seen"


@dataclass(frozen=True)
class CountWhere:
    """Number of rows in the window for which the condition holds."""

    condition: Column


@dataclass(frozen=True)
class DistinctOf:
    """Number of different values in the window; ``values`` is an array column."""

    values: Column


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _step_rows(df: DataFrame, keys: Sequence[str], at: Sequence[Column],
               deltas: Sequence[Mapping[str, Column]], emit: Sequence[Column]) -> DataFrame:
    """Row i of each input row: instant ``at[i]`` with the deltas i, where ``emit[i]``.

    Plain CASE expressions over an exploded index stay in generated code.
    """
    names = list(deltas[0])
    index = F.col("_i")

    def pick(values: Sequence[Column]) -> Column:
        chosen = F.when(index == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            chosen = chosen.when(index == i, value)
        return chosen

    def pick_delta(name: str) -> Column:
        parts = [(i, d[name]) for i, d in enumerate(deltas) if d[name] is not None]
        if not parts:
            return F.lit(0).cast("long")
        chosen = F.when(index == parts[0][0], parts[0][1])
        for i, value in parts[1:]:
            chosen = chosen.when(index == i, value)
        return chosen.otherwise(F.lit(0)).cast("long")

    rows = df.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(len(at))])))
    return rows.filter(pick(emit)).select(
        *keys, pick(at).alias("_at"), *[pick_delta(n).alias(n) for n in names])


def _count_steps(rows: DataFrame, counts: Sequence[str], widths: Mapping[str, int],
                 keys: Sequence[str], outputs: Sequence[tuple[str, str]]) -> DataFrame:
    """A rise row for every record (also where nothing is counted), and fall rows.

    The sum per instant that follows combines them map-side, so an instant
    shared by very many records is one row per task before it is shuffled.
    """
    t = F.col("_t")
    anything = F.lit(False)
    for c in counts:
        anything = anything | (F.col(c) > 0)
    at, emit = [t], [F.lit(True)]
    deltas = [{_out(w, m): F.col(m) if m in counts else None for w, m in outputs}
              | {_SEEN: F.lit(1)}]
    for width, micros in widths.items():
        at.append(t + micros + 1)
        emit.append(anything)
        deltas.append({_out(w, m): -F.col(m) if m in counts and w == width else None
                       for w, m in outputs} | {_SEEN: None})
    return _step_rows(rows, keys, at, deltas, emit)


def _distinct_steps(rows: DataFrame, distincts: Sequence[str], widths: Mapping[str, int],
                    keys: Sequence[str], outputs: Sequence[tuple[str, str]]) -> DataFrame:
    number = {m: i for i, m in enumerate(distincts)}

    def tag(measure: str) -> Column:
        mark = F.lit(number[measure])
        return F.transform(F.col(measure), lambda v: F.struct(mark.alias("_m"), v.alias("_v")))

    tagged = F.flatten(F.array(*[tag(m) for m in distincts]))
    seen = (
        rows.select(*keys, "_t", F.inline(tagged)).filter(F.col("_v").isNotNull()).distinct()
    )
    near = neighbours(seen, "_t", "_t", [*keys, "_m", "_v"])
    t, before, after = F.col("_t"), F.col("prev_value"), F.col("next_value")
    starts = {w: before.isNull() | (before < t - us) for w, us in widths.items()}
    ends = {w: after.isNull() | (after > t + us) for w, us in widths.items()}

    def of(measure: str, condition: Column, delta: int) -> Column:
        return F.when((F.col("_m") == number[measure]) & condition, delta).otherwise(0)

    narrowest = min(widths, key=widths.get)  # a gap wider than any window is wider than this one
    at, emit = [t], [starts[narrowest]]
    deltas = [{_out(w, m): of(m, starts[w], 1) if m in number else None for w, m in outputs}
              | {_SEEN: None}]
    for width, micros in widths.items():
        at.append(t + micros + 1)
        emit.append(ends[width])
        deltas.append({_out(w, m): of(m, F.lit(True), -1) if m in number and w == width else None
                       for w, m in outputs} | {_SEEN: None})
    return _step_rows(near, keys, at, deltas, emit)


def _out(width: str, measure: str) -> str:
    return f"{width}_{measure}"


def trailing_windows(
    df: DataFrame,
    ts: str,
    measures: Mapping[str, CountWhere | DistinctOf],
    minutes: Mapping[str, float] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add one column ``<window>_<measure>`` per pair; null where ``ts`` is null."""
    minutes = minutes or fixed.WINDOWS
    keys = list(keys)
    widths = {w: int(m * MICROS_PER_MINUTE) for w, m in minutes.items()}
    outputs = [(w, m) for w in widths for m in measures]
    names = [_out(w, m) for w, m in outputs]
    counts = [m for m, kind in measures.items() if isinstance(kind, CountWhere)]
    distincts = [m for m, kind in measures.items() if isinstance(kind, DistinctOf)]

    # one struct for all keys: never null itself, and equal when the parts are
    # equal or absent on both sides
    by = ["_k"] if keys else []
    stamped = df.withColumn("_t", _micros(ts))
    if keys:
        stamped = stamped.withColumn("_k", F.struct(*keys))

    rows = stamped.select(
        *by, "_t",
        *[F.when(measures[m].condition, 1).otherwise(0).cast("long").alias(m) for m in counts],
        *[measures[m].values.cast("array<string>").alias(m) for m in distincts],
    ).filter(F.col("_t").isNotNull())

    steps = _count_steps(rows, counts, widths, by, outputs)
    if distincts:
        steps = steps.unionByName(_distinct_steps(rows, distincts, widths, by, outputs))
    # read once for the sums inside blocks and once for those of whole blocks
    per_instant = store(steps.groupBy(*by, "_at").agg(
        F.max(_SEEN).alias(_SEEN), *[F.sum(c).alias(c) for c in names]), "instants")
    # instants at which something only leaves a window are of no record
    table = (
        running_sum(per_instant, "_at", names, by).filter(F.col(_SEEN) > 0).drop(_SEEN)
        .withColumnRenamed("_at", "_t")
    )
    return stamped.join(table, [*by, "_t"], "left").drop("_t", *by)


def log_measures(message: str = "message", process: str = "process_name") -> dict:
    """The four measures of a device log."""
    text = F.col(message)
    return {
        "connection_count": CountWhere(mentions(text, fixed.CONNECTED)),
        "unique_macs": DistinctOf(F.coalesce(mac_addresses(text), F.array())),
        "error_count": CountWhere(mentions(text, fixed.FAILURE)),
        "process_diversity": DistinctOf(F.array(F.col(process))),
    }


WINDOW_FEATURES = tuple(
    _out(w, m) for w in fixed.WINDOWS
    for m in ("connection_count", "unique_macs", "error_count", "process_diversity")
)


def window_features(
    df: DataFrame, ts: str = "log_ts", message: str = "message", process: str = "process_name",
    minutes: Mapping[str, float] | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """The twelve trailing-window features of a device log."""
    return trailing_windows(df, ts, log_measures(message, process), minutes, keys)


def rolling_count(df: DataFrame, ts: str, condition: Column, minutes: float,
                  name: str = "rolling_count", keys: Sequence[str] = ()) -> DataFrame:
    """Rows in [t - minutes, t] for which the condition holds, optionally per key."""
    out = trailing_windows(df, ts, {"count": CountWhere(condition)}, {"_w": minutes}, keys)
    return out.withColumnRenamed("_w_count", name)


def rolling_distinct(df: DataFrame, ts: str, column: str, minutes: float,
                     name: str = "rolling_distinct", keys: Sequence[str] = ()) -> DataFrame:
    """Different values of a scalar or array column in [t - minutes, t]."""
    value = F.col(column)
    if not df.schema[column].dataType.typeName() == "array":
        value = F.array(value)
    out = trailing_windows(df, ts, {"distinct": DistinctOf(value)}, {"_w": minutes}, keys)
    return out.withColumnRenamed("_w_distinct", name)
