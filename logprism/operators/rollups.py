"""Stored roll-ups of device logs by hour, merged for any span without reading the logs.

A row of the roll-up stands for one hour and one value of the keys.  Counts and
sums merge exactly.  What does not add up is kept as a sketch, with a bounded
size whatever the number of logs:

* devices and addresses: HyperLogLog of 2^``LOG_K`` registers; the relative
  error of a distinct count is about 1.04 / sqrt(2^LOG_K), 1.6 % for 12;
* message lengths and metric values: KLL quantiles, rank error about 1 % for ``KLL_K`` 400;
* reason, status and channel codes: the most frequent of ``TRACKED`` codes held;
  exact as long as no more different ones occur.

Rows without a time belong to no hour and are left out.  The exact functions of
``summary``, ``loganalytics`` and ``evaluate`` stay the ones to use where their
cost does not matter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.functions.features import mac_addresses
from logprism.operators.summary import CODES, _number, event_kind

LOG_K = 12
KLL_K = 400
TRACKED = 1000
KINDS = ("auth_failure", "deauth", "beacon", "association", "disassociation")
NUMBERS = {"signal": fixed.SIGNAL, "rate": fixed.DATA_RATE, "loss": fixed.PACKET_LOSS}
SKETCHES = ("devices", "macs", "lengths", "metrics", *(f"{kind}_codes" for kind in CODES))


def hourly_rollup(
    logs: DataFrame, keys: Sequence[str] = (), ts: str = "log_ts", message: str = "message", level: str = "log_level",
    device: str = "device_id", metric: str | None = None,
) -> DataFrame:
    """One row per hour and key: counts, sums and sketches."""
    text = F.coalesce(F.col(message), F.lit(""))
    macs = F.transform(mac_addresses(text), F.lower)
    rows = logs.filter(F.col(ts).isNotNull()).select(
        F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour"), *keys,
        F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(device).cast("string").alias("_device"), macs.alias("_macs"),
        event_kind(text).alias("_kind"), F.upper(level).alias("_level"), F.length(text).cast("long").alias("_length"),
        (F.lit(None) if metric is None else F.col(metric)).cast("double").alias("_metric"),
        *[_number(text, p).alias(f"_{n}") for n, p in NUMBERS.items()],
        *[F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")).alias(f"_{kind}_code") for kind, p in CODES.items()])
    plain = rows.groupBy("hour", *keys).agg(
        F.count("*").alias("rows"), F.min("_t").alias("first_us"), F.max("_t").alias("last_us"),
        F.count_if(F.col("_level").isin("ERROR", "CRITICAL")).alias("errors"), F.count_if(F.col("_level") == "WARNING").alias("warnings"),
        *[F.count_if(F.col("_kind") == k).alias(f"{k}_rows") for k in KINDS],
        *[F.count(f"_{n}").alias(f"{n}_n") for n in NUMBERS],
        *[F.coalesce(F.sum(f"_{n}"), F.lit(0.0)).alias(f"{n}_sum") for n in NUMBERS],
        *[F.coalesce(F.sum(F.col(f"_{n}") * F.col(f"_{n}")), F.lit(0.0)).alias(f"{n}_squares") for n in NUMBERS],
        F.sum("_length").alias("length_sum"),
        F.hll_sketch_agg("_device", LOG_K).alias("devices"), F.kll_sketch_agg_bigint("_length", KLL_K).alias("lengths"),
        F.kll_sketch_agg_double("_metric", KLL_K).alias("metrics"),
        *[F.expr(f"approx_top_k_accumulate(_{kind}_code, {TRACKED}) filter (where _{kind}_code is not null)").alias(f"{kind}_codes") for kind in CODES])
    # addresses are several to a row, so they are counted from rows of their own
    each = rows.select("hour", *keys, F.explode_outer("_macs").alias("_mac"))
    addresses = each.groupBy("hour", *keys).agg(F.hll_sketch_agg("_mac", LOG_K).alias("macs"))
    same = F.struct("hour", *keys)
    return plain.withColumn("_k", same).join(addresses.select(same.alias("_k"), "macs"), "_k").drop("_k")


def write_rollup(rollup: DataFrame, path: str, mode: str = "append") -> None:
    """Store a roll-up by day, so that a span reads only its days."""
    days = rollup.withColumn("day", F.to_date("hour"))
    days.repartition("day").write.mode(mode).partitionBy("day").parquet(path)


def span(rollup: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The hours that begin in [start, end); both at full hours.  A stored roll-up is pruned to its days."""
    out = rollup
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            at = F.lit(bound).cast("timestamp")
            out = out.filter(F.col("hour") >= at if after else F.col("hour") < at)
            if "day" in rollup.columns:
                out = out.filter(F.col("day") >= F.to_date(at) if after else F.col("day") <= F.to_date(at))
    return out


def merged(rollup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of a roll-up merged per key, in the same form without the hour, so merges may be merged again."""
    sums = [c for c in rollup.columns if c == "rows" or c in ("errors", "warnings") or c.endswith(("_rows", "_n", "_sum", "_squares"))]
    by = list(keys) or [F.lit(0).alias("_all")]  # a span without rows gives no row
    return rollup.groupBy(*by).agg(
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), *[F.sum(c).alias(c) for c in sums],
        *[F.hll_union_agg(c, False).alias(c) for c in ("devices", "macs")],
        F.kll_merge_agg_bigint("lengths").alias("lengths"), F.kll_merge_agg_double("metrics").alias("metrics"),
        *[F.expr(f"approx_top_k_combine({kind}_codes, {TRACKED})").alias(f"{kind}_codes") for kind in CODES])


def rollup_summary(
    rollup: DataFrame, keys: Sequence[str] = (), quantiles: Mapping[str, float] | None = None, top: int = fixed.CODE_TOP,
) -> DataFrame:
    """Totals, ratios to rows, means, distinct counts, quantiles of lengths and metrics, and the most frequent codes of a span."""
    quantiles = quantiles or {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    whole = merged(rollup, keys)
    per = F.col("rows").cast("double")

    def spread(name: str):
        mean = F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n"))
        square = F.try_divide(F.col(f"{name}_squares"), F.col(f"{name}_n"))
        return F.when(mean.isNotNull(), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))

    return whole.select(
        *keys, "rows", "first_us", "last_us", "errors", "warnings", *[f"{k}_rows" for k in KINDS],
        F.try_divide("errors", per).alias("error_share"), F.try_divide("warnings", per).alias("warning_share"),
        *[F.try_divide(F.col(f"{n}_sum"), F.col(f"{n}_n")).alias(f"mean_{n}") for n in NUMBERS],
        *[spread(n).alias(f"std_{n}") for n in NUMBERS], F.try_divide(F.col("length_sum"), per).alias("mean_length"),
        F.hll_sketch_estimate("devices").alias("devices"), F.hll_sketch_estimate("macs").alias("macs"),
        *[F.when(F.kll_sketch_get_n_bigint("lengths") > 0, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q))).alias(f"length_{n}")
          for n, q in quantiles.items()],
        *[F.when(F.kll_sketch_get_n_double("metrics") > 0, F.kll_sketch_get_quantile_double("metrics", F.lit(q))).alias(f"metric_{n}")
          for n, q in quantiles.items()],
        *[F.expr(f"transform(approx_top_k_estimate({kind}_codes, {top}), x -> struct(x.item as code, x.count as n))").alias(f"{kind}_codes")
          for kind in CODES])
