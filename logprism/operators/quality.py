"""Data-quality rules: one output row per violation.

Rules run on a *field frame*: file, record_idx, and for every field a struct
(present, is_string, text).  It is made from export documents, where an absent
field differs from a null one, or from a table, where null means absent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.functions.formats import is_iso, matches, parse_iso
from logprism.operators.ordered import neighbours
from logprism.session import store

_INTEGER = r"^(BIGINT|DECIMAL\(\d+,0\))$"


# --- documents ---------------------------------------------------------------

def parse_documents(documents: DataFrame) -> DataFrame:
    """Add ``keys`` (null: no JSON object), ``meta`` (variant), ``records`` (texts)."""
    parsed = F.from_json("body", "data array<string>")
    meta = F.try_parse_json(F.get_json_object("body", "$.export_metadata"))
    return documents.withColumns({
        "keys": F.json_object_keys("body"),
        "meta": meta,
        "records": parsed["data"],
    })


def _type_of(variant: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(variant, f"$.{name}", "variant"))


def _has(keys: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(keys, name), F.lit(False))


def _broken_structure(docs: DataFrame, lenient: bool) -> dict[str, Column]:
    keys = F.col("keys")
    required = ("data",) if lenient else fixed.EXPORT_FIELDS
    rules = {"invalid_json": keys.isNull()}
    for name in required:
        rules[f"missing_{name}"] = keys.isNotNull() & ~_has(keys, name)
    kind = F.coalesce(F.schema_of_variant(F.col("meta")), F.lit(""))
    rules["export_metadata_not_object"] = _has(keys, "export_metadata") & ~kind.startswith("OBJECT")
    rules["data_not_array"] = _has(keys, "data") & F.col("records").isNull()
    return rules


def _broken_metadata(lenient: bool) -> dict[str, Column]:
    meta = F.col("meta")
    # a variant path that does not exist has no type; a null has type VOID
    present = {f: _type_of(meta, f).isNotNull() for f in fixed.METADATA_FIELDS}
    text = {f: F.try_variant_get(meta, f"$.{f}", "string") for f in fixed.METADATA_FIELDS}
    bad_date = present["created_at"] & ~F.coalesce(is_iso(text["created_at"]), F.lit(False))
    if lenient:
        return {"invalid_created_at": bad_date}
    total = F.try_variant_get(meta, "$.total_records", "decimal(38,0)")
    whole = _type_of(meta, "total_records").rlike(_INTEGER) & (total >= 0)
    return {
        **{f"missing_metadata_{f}": ~present[f] for f in fixed.METADATA_FIELDS},
        "invalid_created_at": bad_date,
        "invalid_total_records": present["total_records"] & ~F.coalesce(whole, F.lit(False)),
        "unsupported_format": present["format"]
        & ~F.coalesce(text["format"] == fixed.EXPORT_FORMAT, F.lit(False)),
    }


def _explode_rules(df: DataFrame, rules: Mapping[str, Column], *keep: str) -> DataFrame:
    hits = F.array(*[F.when(condition, F.lit(rule)) for rule, condition in rules.items()])
    return df.select(*keep, F.explode(F.filter(hits, lambda r: r.isNotNull())).alias("rule"))


def document_violations(documents: DataFrame, lenient: bool = False) -> DataFrame:
    """Rows (file, record_idx = null, rule) for structure, metadata and empty data."""
    docs = parse_documents(documents)
    structure = _broken_structure(docs, lenient)
    sound = ~reduce(Column.__or__, structure.values())
    later = {} if lenient else {"empty_data": F.size("records") == 0}
    # metadata rules apply where metadata is there; strict structure demands it
    with_meta = {k: v & _has(F.col("keys"), "export_metadata") for k, v in _broken_metadata(lenient).items()}
    rules = {**structure, **{k: sound & v for k, v in (with_meta | later).items()}}
    return _explode_rules(docs, rules, "file").select("file", F.lit(None).cast("long").alias("record_idx"), "rule")


def document_fields(documents: DataFrame, lenient: bool = False) -> DataFrame:
    """Field frame of the records of structurally sound documents."""
    docs = parse_documents(documents)
    sound = ~reduce(Column.__or__, _broken_structure(docs, lenient).values())
    names = (*fixed.RECORD_FIELDS, "structured_data")
    rows = docs.filter(sound).select("file", F.posexplode("records").alias("record_idx", "_text"))
    rows = rows.withColumn("_v", F.try_parse_json("_text"))
    kind = F.coalesce(F.schema_of_variant("_v"), F.lit(""))

    def field(name: str) -> Column:
        found = _type_of(F.col("_v"), name)
        return F.struct(
            found.isNotNull().alias("present"), (found == "STRING").alias("is_string"),
            F.coalesce(found, F.lit("")).startswith("OBJECT").alias("is_object"),
            F.try_variant_get("_v", f"$.{name}", "string").alias("text"),
        ).alias(name)

    return rows.select(
        "file", F.col("record_idx").cast("long").alias("record_idx"),
        kind.startswith("OBJECT").alias("is_record"), *[field(n) for n in names],
    )


def table_fields(logs: DataFrame, file: str | None, record_idx: str,
                 columns: Mapping[str, str] | None = None) -> DataFrame:
    """Field frame of a table of text columns; null means absent."""
    columns = columns or {f: f for f in fixed.RECORD_FIELDS}

    def field(name: str) -> Column:
        text = F.col(columns[name]).cast("string") if name in columns else F.lit(None).cast("string")
        return F.struct(
            text.isNotNull().alias("present"), text.isNotNull().alias("is_string"),
            F.lit(False).alias("is_object"), text.alias("text"),
        ).alias(name)

    source = F.lit("") if file is None else F.col(file)
    return logs.select(
        source.alias("file"), F.col(record_idx).cast("long").alias("record_idx"),
        F.lit(True).alias("is_record"),
        *[field(n) for n in (*fixed.RECORD_FIELDS, "structured_data")],
    )


# --- records -----------------------------------------------------------------

def record_violations(fields: DataFrame, lenient: bool = False) -> DataFrame:
    """Rows (file, record_idx, rule) of records that break a field rule."""
    at = F.col
    present = {n: at(f"{n}.present") for n in (*fixed.RECORD_FIELDS, "structured_data")}
    not_string = {n: present[n] & ~at(f"{n}.is_string") for n in fixed.RECORD_FIELDS}
    bad_time = ~F.coalesce(at("timestamp.is_string") & is_iso(at("timestamp.text")), F.lit(False))
    known = at("log_level.is_string") & at("log_level.text").isin(*fixed.LEVELS)
    rules = {"not_an_object": ~at("is_record")}
    for name in fixed.LENIENT_FIELDS if lenient else fixed.RECORD_FIELDS:
        rules[f"missing_{name}"] = ~present[name]
    if lenient:
        rules["timestamp_not_string"] = not_string["timestamp"]
        rules["invalid_timestamp"] = present["timestamp"] & at("timestamp.is_string") & bad_time
        rules["structured_data_not_object"] = present["structured_data"] & ~at("structured_data.is_object")
    else:
        rules["invalid_timestamp"] = present["timestamp"] & bad_time
    rules["message_not_string"] = not_string["message"]
    rules["process_name_not_string"] = not_string["process_name"]
    rules["invalid_log_level"] = present["log_level"] & ~F.coalesce(known, F.lit(False))
    only_records = {k: v & at("is_record") if k != "not_an_object" else v for k, v in rules.items()}
    return _explode_rules(fields, only_records, "file", "record_idx")


def order_violations(fields: DataFrame) -> DataFrame:
    """One row per file whose parsable timestamps are not in record order.

    A record breaks the order when the next parsable one is earlier.  The
    neighbour is found in blocks of record numbers, so a file is not one task.
    """
    stamps = fields.select(
        "file", "record_idx", F.unix_micros(parse_iso(F.col("timestamp.text"))).alias("_t")
    ).filter(F.col("_t").isNotNull())
    # read once for the rows inside blocks and again for those at the edges
    near = neighbours(store(stamps, "stamps"), "record_idx", "_t", ["file"])
    return near.filter(F.col("next_value") < F.col("_t")).select("file").distinct().select(
        "file", F.lit(None).cast("long").alias("record_idx"), F.lit("not_chronological").alias("rule")
    )


def duplicate_violations(fields: DataFrame) -> DataFrame:
    """Every repeat of (timestamp, message, process_name) after the first in its file.

    Keys are counted with map-side combine first; only keys that repeat are
    joined back.  A hot key has one row on the right side, so AQE can split
    its partition on the left.
    """
    # a struct is equal to another when the parts are equal or both absent
    keyed = fields.select(
        "file", "record_idx",
        F.struct("timestamp.text", "message.text", "process_name.text").alias("_key"),
    )
    repeated = (
        keyed.groupBy("file", "_key")
        .agg(F.min("record_idx").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        .drop("_n")
    )
    return keyed.join(repeated, ["file", "_key"]).filter(F.col("record_idx") > F.col("_first")).select(
        "file", "record_idx", F.lit("duplicate").alias("rule")
    )


def validate_documents(documents: DataFrame, lenient: bool = False) -> DataFrame:
    """All violations of export documents: file, record_idx, rule.

    Three of the strict rule sets read the records, so the parsed records are
    stored once as columns; the documents are not parsed again for each.
    """
    fields = document_fields(documents, lenient)
    if not lenient:
        fields = store(fields, "fields")
    parts = [document_violations(documents, lenient), record_violations(fields, lenient)]
    if not lenient:
        parts += [order_violations(fields), duplicate_violations(fields)]
    return reduce(DataFrame.unionByName, parts)


def validation_report(documents: DataFrame, violations: DataFrame) -> DataFrame:
    """Per file: whether it is valid, the number of errors, and the count per rule."""
    per_rule = violations.groupBy("file", "rule").agg(F.count("*").alias("n"))
    per_file = per_rule.groupBy("file").agg(
        F.sum("n").alias("error_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias("errors"),
    )
    return documents.select("file", "size_bytes").join(per_file, "file", "left").select(
        "file", "size_bytes", F.col("error_count").isNull().alias("is_valid"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        F.coalesce("errors", F.create_map().cast("map<string,bigint>")).alias("errors"),
    )


def directory_report(report: DataFrame) -> DataFrame:
    """Number of files, of valid and of invalid ones."""
    return report.agg(
        F.count("*").alias("total_files"), F.count_if("is_valid").alias("valid_files"),
        F.count_if(~F.col("is_valid")).alias("invalid_files"),
    )


# --- tables ------------------------------------------------------------------

def training_suitability(logs: DataFrame, ts: str = "log_ts", process: str = "process_name",
                         keys: Sequence[str] = ()) -> DataFrame:
    """Rows, rows of wireless programs, their share, whole days covered, warnings."""
    seconds = (F.max(F.unix_micros(F.col(ts).cast("timestamp")))
               - F.min(F.unix_micros(F.col(ts).cast("timestamp")))) / 1e6
    wifi = F.coalesce(F.col(process).isin(*fixed.WIFI_PROCESSES), F.lit(False))
    out = logs.groupBy(*keys).agg(
        F.count("*").alias("total_records"), F.count_if(wifi).alias("wifi_logs"),
        F.floor(seconds / 86400).alias("time_range_days"),
    )
    ratio = F.coalesce(F.try_divide(F.col("wifi_logs"), F.col("total_records")), F.lit(0.0))
    return out.withColumns({
        "wifi_ratio": ratio,
        "low_wifi_ratio": ratio < fixed.MIN_WIFI_RATIO,
        "short_time_range": F.coalesce(F.col("time_range_days") < fixed.MIN_DAYS, F.lit(False)),
    })


def format_profile(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Per column: how many values match the format, how many do not, how many are absent."""
    sums = []
    for column, kind in kinds.items():
        value = F.col(column).cast("string")
        good = matches(kind, value)
        sums += [
            F.count_if(good).alias(f"_good_{column}"),
            F.count_if(value.isNotNull() & ~good).alias(f"_bad_{column}"),
            F.count_if(value.isNull()).alias(f"_none_{column}"),
        ]
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("format"),
                 F.col(f"_good_{c}").alias("valid"), F.col(f"_bad_{c}").alias("invalid"),
                 F.col(f"_none_{c}").alias("absent"))
        for c, k in kinds.items()
    ]
    return df.agg(*sums).select(F.inline(F.array(*rows)))
