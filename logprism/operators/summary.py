"""One vector per set of logs: ratios, distinct counts, means, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.functions import fixed
from logprism.functions.features import mac_addresses, mentions

SUMMARY_NAMES = (
    "auth_failure_ratio", "deauth_ratio", "beacon_ratio",
    "unique_mac_count", "unique_ssid_count", "failed_auth_mac_count",
    "mean_signal_strength", "std_signal_strength", "mean_data_rate", "mean_packet_loss",
    "mean_hour_of_day", "mean_day_of_week", "mean_time_between_events",
    "error_ratio", "warning_ratio", "total_devices", "max_device_activity", "mean_device_activity",
    "association_count", "disassociation_count",
)


def _number(message: Column, pattern: str) -> Column:
    """First number after a label, null if there is none (or it is out of range).

    As a double: sums and squares of what a message claims may leave the range of a long.
    """
    return F.regexp_extract(message, f"(?i){pattern}", 1).try_cast("long").cast("double")


def event_kind(message: Column) -> Column:
    """The first event that applies; 'disassociation' is tested before its suffix."""
    return (
        F.when(mentions(message, fixed.AUTH_FAILURE), "auth_failure")
        .when(mentions(message, fixed.DEAUTH), "deauth")
        .when(mentions(message, fixed.BEACON), "beacon")
        .when(mentions(message, "disassociation"), "disassociation")
        .when(mentions(message, "association"), "association")
    )


def _set_counts(logs: DataFrame, keys: list[str], message: str) -> DataFrame:
    """Distinct addresses, networks and addresses with failed authentication."""
    text = F.coalesce(F.col(message), F.lit(""))
    macs = F.transform(mac_addresses(text), F.lower)
    failed = event_kind(text) == "auth_failure"
    ssid = F.nullif(F.regexp_extract(text, f"(?i){fixed.SSID}", 1), F.lit(""))

    def tagged(values: Column, tag: str) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(tag).alias("_kind"), v.alias("_value")))

    values = F.flatten(F.array(
        tagged(macs, "mac"), tagged(F.when(failed, macs).otherwise(F.array()), "failed"),
        tagged(F.array_compact(F.array(ssid)), "ssid"),
    ))
    seen = logs.select(*keys, F.inline(values)).distinct()
    count = lambda kind, name: F.count_if(F.col("_kind") == kind).alias(name)
    return seen.groupBy(*keys).agg(
        count("mac", "unique_mac_count"), count("ssid", "unique_ssid_count"),
        count("failed", "failed_auth_mac_count"),
    )


def summary_features(
    logs: DataFrame, keys: Sequence[str] = (), ts: str = "log_ts", message: str = "message",
    level: str = "log_level", device: str = "device_id",
) -> DataFrame:
    """One row per key (or one row in all) with the columns of ``SUMMARY_NAMES``.

    Rows are first combined per key and device, which counts devices without a
    distinct aggregate; the distinct values are counted in a second, narrow
    aggregation.
    """
    keys = list(keys)
    renamed = {k: f"_key{i}" for i, k in enumerate(keys)}
    logs = logs.withColumns({v: F.col(k) for k, v in renamed.items()})
    by = list(renamed.values())
    text = F.coalesce(F.col(message), F.lit(""))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    numbers = {"signal": fixed.SIGNAL, "rate": fixed.DATA_RATE, "loss": fixed.PACKET_LOSS}
    rows = logs.select(
        *by, F.col(device).alias("_device"), event_kind(text).alias("_kind"),
        F.upper(level).alias("_level"), micros.alias("_t"),
        F.hour(ts).alias("_hour"), F.weekday(ts).alias("_weekday"),
        *[_number(text, p).alias(f"_{n}") for n, p in numbers.items()],
    )
    kinds = ("auth_failure", "deauth", "beacon", "association", "disassociation")
    per_device = rows.groupBy(*by, "_device").agg(
        F.count("*").alias("_n"), F.count("_t").alias("_timed"),
        F.min("_t").alias("_from"), F.max("_t").alias("_to"),
        F.sum("_hour").alias("_hours"), F.sum("_weekday").alias("_weekdays"),
        F.count_if(F.col("_level").isin("ERROR", "CRITICAL")).alias("_errors"),
        F.count_if(F.col("_level") == "WARNING").alias("_warnings"),
        *[F.count_if(F.col("_kind") == k).alias(f"_{k}s") for k in kinds],
        *[F.count(f"_{n}").alias(f"_{n}_n") for n in numbers],
        *[F.sum(f"_{n}").alias(f"_{n}_s") for n in numbers],
        F.sum(F.col("_signal") * F.col("_signal")).alias("_signal_q"),
    )
    total = lambda c: F.sum(c).cast("double")
    devices = F.greatest(F.count("*"), F.lit(1)).cast("double")

    def mean(name: str, count: str, default: float) -> Column:
        return F.coalesce(F.try_divide(total(name), total(count)), F.lit(default))

    signal_mean = F.try_divide(total("_signal_s"), total("_signal_n"))
    signal_square = F.try_divide(total("_signal_q"), total("_signal_n"))
    out = per_device.groupBy(*by).agg(
        *[(F.sum(f"_{k}s") / devices).alias(f"{k}_ratio") for k in ("auth_failure", "deauth", "beacon")],
        mean("_signal_s", "_signal_n", 0.0).alias("mean_signal_strength"),
        F.coalesce(F.sqrt(F.greatest(signal_square - signal_mean * signal_mean, F.lit(0.0))), F.lit(0.0))
        .alias("std_signal_strength"),
        mean("_rate_s", "_rate_n", 0.0).alias("mean_data_rate"),
        mean("_loss_s", "_loss_n", 0.0).alias("mean_packet_loss"),
        mean("_hours", "_timed", fixed.DEFAULT_HOUR).alias("mean_hour_of_day"),
        mean("_weekdays", "_timed", fixed.DEFAULT_WEEKDAY).alias("mean_day_of_week"),
        # the gaps between ordered events add up to the whole span
        F.coalesce(F.try_divide((F.max("_to") - F.min("_from")) / 1e6, F.sum("_timed") - 1), F.lit(0.0))
        .alias("mean_time_between_events"),
        (F.sum("_errors") / devices).alias("error_ratio"),
        (F.sum("_warnings") / devices).alias("warning_ratio"),
        F.count("*").alias("total_devices"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_device_activity"),
        F.coalesce(F.avg("_n"), F.lit(0.0)).alias("mean_device_activity"),
        F.coalesce(F.sum("_associations"), F.lit(0)).alias("association_count"),
        F.coalesce(F.sum("_disassociations"), F.lit(0)).alias("disassociation_count"),
    )
    sets = _set_counts(logs, by, message)
    counted = ("unique_mac_count", "unique_ssid_count", "failed_auth_mac_count")
    if by:
        whole = F.struct(*by)  # null-safe comparison of all keys at once
        joined = out.withColumn("_k", whole).join(
            sets.select(whole.alias("_k"), *counted), "_k", "left")
        filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})
    else:
        row = sets.select(F.struct(*counted)).scalar()
        filled = out.withColumns({c: row.getField(c) for c in counted})
    return filled.select(*[F.col(v).alias(k) for k, v in renamed.items()], *SUMMARY_NAMES)


CODES = {
    "reason": fixed.REASON_CODE, "status": fixed.STATUS_CODE, "channel": fixed.CHANNEL,
}


def code_counts(logs: DataFrame, kind: str, keys: Sequence[str] = (), top: int | None = fixed.CODE_TOP,
                message: str = "message") -> DataFrame:
    """Counts of reason codes, status codes or channels; with ``top``, the most frequent."""
    code = F.nullif(F.regexp_extract(message, f"(?i){CODES[kind]}", 1), F.lit(""))
    counted = (
        logs.select(*keys, code.alias("code")).filter(F.col("code").isNotNull())
        .groupBy(*keys, "code").agg(F.count("*").alias("n"))
    )
    if top is None:
        return counted
    if not keys:
        return counted.orderBy(F.desc("n"), "code").limit(top)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "code")
    return counted.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= top).drop("_k")


def code_map(logs: DataFrame, kind: str, keys: Sequence[str] = (), top: int = fixed.CODE_TOP,
             message: str = "message") -> DataFrame:
    """The most frequent codes as one map per key."""
    counted = code_counts(logs, kind, keys, top, message)
    entries = F.map_from_entries(F.collect_list(F.struct("code", "n")))
    return counted.groupBy(*keys).agg(entries.alias(f"{kind}_codes"))


def program_counts(logs: DataFrame, keys: Sequence[str] = (), process: str = "process_name") -> DataFrame:
    return logs.groupBy(*keys, F.coalesce(process, F.lit("")).alias(process)).agg(F.count("*").alias("n"))
