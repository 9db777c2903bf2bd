"""Format predicates over string columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logprism.functions import fixed


#: The extended form to the second, which a cast reads by itself.
USUAL_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})?$"


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to TIMESTAMP, null when the text is not ISO-8601.

    A bare cast also takes '2024' or '10:00' and no basic forms.  The usual form
    is cast after one match; of the others the parts are taken by pattern and
    put together again.  Fractions are cut to microseconds; missing minutes and
    seconds are 0.
    """
    def part(group: int, default: str) -> Column:
        found = F.regexp_extract(text, fixed.ISO_FORMAT, group)
        return F.when(found == "", default).otherwise(found)

    offset = F.regexp_replace(part(10, ""), r"^([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    offset = F.when(offset.rlike(r"^[+-][0-9]{2}$"), F.concat(offset, F.lit(":00"))).otherwise(offset)
    whole = F.concat(
        part(1, ""), F.lit("-"), part(3, ""), F.lit("-"), part(4, ""), F.lit("T"), part(5, "00"), F.lit(":"),
        part(7, "00"), F.lit(":"), part(8, "00"), F.lit("."), F.substring(part(9, "0"), 1, 6), offset)
    return F.when(text.rlike(USUAL_ISO), F.try_to_timestamp(text)).when(
        text.rlike(fixed.ISO_FORMAT), F.try_to_timestamp(whole))


def is_iso(text: Column) -> Column:
    return parse_iso(text).isNotNull()


def has_extension(name: Column, allowed: Iterable[str]) -> Column:
    """Whether a file name ends in one of the extensions (dot optional)."""
    wanted = ["." + e.lower().lstrip(".") for e in allowed]
    # the last dot of the base name starts the extension, unless it leads the name
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)).isin(wanted)


def fits_size(size_bytes: Column, max_mb: float) -> Column:
    return size_bytes / F.lit(1024.0 * 1024.0) <= F.lit(float(max_mb))


PREDICATES = {
    "email": lambda c: c.rlike(fixed.EMAIL_FORMAT),
    "url": lambda c: c.rlike(fixed.URL_FORMAT),
    "mac": lambda c: c.rlike(fixed.MAC_FORMAT),
    "ipv4": lambda c: c.rlike(fixed.IPV4_FORMAT),
    "iso_timestamp": is_iso,
}


def matches(kind: str, column: Column) -> Column:
    """Predicate of the given kind; an absent value does not match."""
    if kind not in PREDICATES:
        raise ValueError(f"unknown format {kind!r}; choose from {sorted(PREDICATES)}")
    return F.coalesce(PREDICATES[kind](column), F.lit(False))
