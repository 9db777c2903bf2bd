"""Numeric features of one log record, as built-in column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from logprism.functions import fixed

TIME_FEATURES = (
    "hour_of_day", "day_of_week", "minute_of_hour", "time_since_midnight",
    "is_weekend", "is_business_hours",
)
WIFI_FEATURES = (
    "is_connection_event", "is_auth_event", "is_error_event",
    "mac_count", "ip_count", "message_length",
)
TEXT_FEATURES = (
    "word_count", "special_char_count", "uppercase_ratio", "number_count", "unique_chars",
)
PROCESS_FEATURES = ("process_rank", "log_level_numeric", "process_frequency")

CAPITALS = string.ascii_uppercase

#: The twenty per-record features, in their fixed order.
FEATURE_NAMES = TIME_FEATURES + WIFI_FEATURES + TEXT_FEATURES + PROCESS_FEATURES


def mentions(text: Column, pattern: str) -> Column:
    """Case-insensitive search for a pattern; ``u`` folds non-ASCII letters too."""
    return text.rlike(f"(?iu){pattern}")


def mac_addresses(text: Column) -> Column:
    """All complete hardware addresses in a text, case kept."""
    return F.regexp_extract_all(text, F.lit(fixed.MAC), F.lit(0))


def ip_addresses(text: Column) -> Column:
    """All dotted quads in a text; octets are not range-checked."""
    return F.regexp_extract_all(text, F.lit("(?U)" + fixed.IPV4_IN_TEXT), F.lit(0))


def time_features(ts: Column) -> dict[str, Column]:
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "hour_of_day": hour,
        "day_of_week": weekday,
        "minute_of_hour": F.minute(ts),
        "time_since_midnight": hour * 3600 + F.minute(ts) * 60 + F.second(ts),
        "is_weekend": (weekday >= 5).cast("int"),
        "is_business_hours": (
            (hour >= fixed.BUSINESS_START) & (hour < fixed.BUSINESS_END)
        ).cast("int"),
    }


def wifi_features(message: Column) -> dict[str, Column]:
    return {
        "is_connection_event": mentions(message, fixed.CONNECTION_EVENT).cast("int"),
        "is_auth_event": mentions(message, fixed.AUTH_EVENT).cast("int"),
        "is_error_event": mentions(message, fixed.ERROR_EVENT).cast("int"),
        "mac_count": F.size(mac_addresses(message)),
        "ip_count": F.size(ip_addresses(message)),
        "message_length": F.length(message),
    }


def text_features(message: Column) -> dict[str, Column]:
    """Text shape.

    ``(?U)`` makes digit and space classes Unicode-aware; the separators
    0x1c-0x1f count as space too.
    """
    length = F.length(message)
    rest = F.regexp_replace(message, r"(?U)[a-zA-Z0-9\s\x1c-\x1f]+", "")
    no_digits = F.regexp_replace(message, r"(?U)\d", "")
    no_capitals = F.translate(message, CAPITALS, "")
    return {
        # runs of non-space characters: a blank text has none
        "word_count": F.regexp_count(message, F.lit(r"(?U)[^\s\x1c-\x1f]+")),
        # counting by what is left is cheaper than collecting the matches
        "special_char_count": F.length(rest),
        "uppercase_ratio": (length - F.length(no_capitals)) / F.greatest(length, F.lit(1)),
        "number_count": length - F.length(no_digits),
        "unique_chars": F.when(length == 0, F.lit(0)).otherwise(
            F.size(F.array_distinct(F.split(message, "")))
        ),
    }


def level_number(level: Column) -> Column:
    """Severity 0..4; unknown or absent levels count as INFO."""
    number = F.lit(None).cast("int")
    for name in reversed(fixed.LEVELS):
        number = F.when(level == name, fixed.LEVEL_NUMBERS[name]).otherwise(number)
    return F.coalesce(number, F.lit(fixed.LEVEL_DEFAULT))
