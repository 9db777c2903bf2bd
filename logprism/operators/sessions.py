"""Link features of devices: sessions, stability, concurrent load, signal trend, kinds of device and link.

A device's *session* begins with a connect event and ends with its next link
event: a disconnect, or another connect (the link was lost unseen and begins
anew); the last one stays open to the end of the logs.  Where a connect and a
disconnect of one device fall on the same microsecond, the disconnect comes
first.  Events without a device or a time have no part in sessions.

* ``connection_stability``: share of the time from the first connect to the end
  of the logs in which the device is connected.
* ``network_load``: open sessions at a time; per hour the time-weighted mean and
  the peak.
* ``signal_strength_trend``: slope of the stated signal over time, per hour.
* ``device_type``: ``private`` where the address is locally administered (the
  second bit of its first octet), else ``vendor``.
* ``connection_type``: the band of the stated channel, ``2.4GHz`` for 1 to 14,
  ``5GHz`` for 32 to 177.

The next event of a device is looked up in blocks of time, and the load is a
running sum of steps in such blocks, so neither a device with very many events
nor the whole log is ever one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.functions.features import mac_addresses, mentions
from logprism.operators.ordered import neighbours, running_sum
from logprism.session import store

HOUR = 3_600_000_000
DISCONNECT = f"AP-STA-DISCONNECTED|STA-DISASSOC|{fixed.DEAUTH}"


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sessions(logs: DataFrame, device: str = "device_id", ts: str = "log_ts", message: str = "message") -> DataFrame:
    """``device, start_us, end_us, ended_by`` (disconnect, reconnect or open) and ``log_end_us``, the last time of all logs."""
    text = F.coalesce(F.col(message), F.lit(""))
    events = logs.select(
        F.col(device).alias("device"), _micros(ts).alias("_t"),
        mentions(text, fixed.CONNECTED).alias("_on"), mentions(text, DISCONNECT).alias("_off"))
    last = events.agg(F.max("_t")).scalar()
    events = events.filter("device is not null and _t is not null and (_on or _off)")
    # one row for each device and instant; an instant's number is odd if it disconnects
    instants = events.groupBy("device", "_t").agg(F.max("_on").alias("_on"), F.max("_off").alias("_off"))
    instants = store(instants.withColumn("_code", 2 * F.col("_t") + F.col("_off").cast("long")), "link-events")
    near = neighbours(instants.drop("_off"), "_t", "_code", ["device"]).filter("_on")
    end = F.shiftright("next_value", 1)
    return near.select(
        "device", F.col("_t").alias("start_us"), F.coalesce(end, last).alias("end_us"),
        F.when(F.col("next_value").isNull(), "open").when(F.col("next_value") % 2 == 1, "disconnect")
        .otherwise("reconnect").alias("ended_by"), last.alias("log_end_us"))


def connection_stability(found: DataFrame) -> DataFrame:
    """Per device of :func:`sessions`: sessions, drops, connected and observed seconds, stability (null if nothing is observed)."""
    per = found.groupBy("device").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("ended_by") == "disconnect").alias("drops"),
        F.sum(F.col("end_us") - F.col("start_us")).alias("_on"), (F.max("log_end_us") - F.min("start_us")).alias("_observed"))
    return per.select(
        "device", "sessions", "drops", (F.col("_on") / 1e6).alias("connected_seconds"),
        (F.col("_observed") / 1e6).alias("observed_seconds"), F.try_divide("_on", "_observed").alias("connection_stability"))


def network_load(found: DataFrame) -> DataFrame:
    """Per clock hour from the first session's start to the last one's end: ``hour_us, mean_load, peak_load``."""
    rise = found.select(F.col("start_us").alias("_t"), F.lit(1).cast("long").alias("_load"))
    fall = found.select(F.col("end_us").alias("_t"), F.lit(-1).cast("long").alias("_load"))
    span = found.agg(F.min("start_us").alias("_low"), F.max("end_us").alias("_high")).filter("_low is not null")
    # a step of zero at each full hour cuts the time into the hours
    marks = span.select(F.explode(F.sequence(
        F.floor(F.col("_low") / HOUR).cast("long") + 1, F.floor(F.col("_high") / HOUR).cast("long"))).alias("_h")).filter(
        F.col("_h") * HOUR < span.select("_high").scalar())
    marks = marks.select((F.col("_h") * HOUR).alias("_t"), F.lit(0).cast("long").alias("_load"))
    steps = store(rise.unionByName(fall).unionByName(marks).groupBy("_t").agg(F.sum("_load").alias("_load")), "load-steps")
    level = running_sum(steps, "_t", ["_load"])
    after = neighbours(steps.select("_t"), "_t", "_t").select("_t", (F.col("next_value") - F.col("_t")).alias("_for"))
    hours = level.join(after, "_t").withColumn("hour_us", F.floor(F.col("_t") / HOUR).cast("long") * HOUR)
    return hours.groupBy("hour_us").agg(
        F.coalesce(F.try_divide(F.sum((F.col("_load") * F.col("_for")).cast("decimal(38,0)")).cast("double"), F.sum("_for")), F.lit(0.0))
        .alias("mean_load"),
        F.max("_load").alias("peak_load"))


def signal_trend(logs: DataFrame, device: str = "device_id", ts: str = "log_ts", message: str = "message") -> DataFrame:
    """Per device with a stated signal: ``readings`` and ``signal_strength_trend`` (null for one time only)."""
    signal = F.regexp_extract(message, f"(?i){fixed.SIGNAL}", 1).try_cast("long").cast("double")
    rows = logs.select(F.col(device).alias("device"), (_micros(ts) / HOUR).alias("_x"), signal.alias("_y")).filter(
        "device is not null and _x is not null and _y is not null")
    return rows.groupBy("device").agg(
        F.count("*").alias("readings"), F.regr_slope("_y", "_x").alias("signal_strength_trend"))


def device_type(message: Column) -> Column:
    """``private`` or ``vendor`` by the first address in a text; null without one."""
    octet = F.conv(F.substring(F.get(mac_addresses(message), 0), 1, 2), 16, 10).cast("int")
    return F.when(octet.bitwiseAND(F.lit(2)) == 2, "private").when(octet.isNotNull(), "vendor")


def connection_type(message: Column) -> Column:
    """The band of the channel that a text states; null without one, or out of both bands."""
    channel = F.regexp_extract(message, f"(?i){fixed.CHANNEL}", 1).try_cast("int")
    return F.when(channel.between(1, 14), "2.4GHz").when(channel.between(32, 177), "5GHz")


def link_features(logs: DataFrame, device: str = "device_id", ts: str = "log_ts", message: str = "message") -> DataFrame:
    """One row per device: stability, trend, and its most frequent device and connection type (first by name if equal)."""
    found = store(sessions(logs, device, ts, message), "sessions")
    rows = logs.filter(F.col(device).isNotNull()).select(F.col(device).alias("device"), F.explode(F.array(
        F.struct(F.lit("device_type").alias("_name"), device_type(F.col(message)).alias("_value")),
        F.struct(F.lit("connection_type").alias("_name"), connection_type(F.col(message)).alias("_value")))).alias("_k"))
    counted = rows.groupBy("device", "_k._name", "_k._value").agg(F.count("*").alias("_n"))

    def most(name: str) -> Column:
        mine = (F.col("_name") == name) & F.col("_value").isNotNull()
        return F.min_by("_value", F.when(mine, F.struct(-F.col("_n"), F.col("_value")))).alias(name)

    kinds = counted.groupBy("device").agg(most("device_type"), most("connection_type"))
    return kinds.join(connection_stability(found), "device", "left").join(
        signal_trend(logs, device, ts, message), "device", "left")
