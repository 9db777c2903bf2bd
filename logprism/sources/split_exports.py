"""Export documents of any size, read in many tasks.

A document is one JSON value, so a JSON reader takes it in one task.  Here the
text reader cuts files at every closing brace, which splits by byte ranges like
lines do, through any file system that Spark reads.  Three scans follow:

1. Each range is summed up for both cases, that it begins inside a string and
   that it does not: number of quotes and change of depth.  One row a range,
   taken in the order of the file, gives every range its true state.
2. From these states, ranges find where the array ``data`` of the top-level
   object begins and ends, and count the records that end in them, so every
   range knows the number of its first record.  What lies before the first and
   behind the last end of a record may be part of one that crosses ranges; it
   is kept, and put together by number.
3. All other records are cut out.

Records are the objects in the first top-level array ``data``; members of it
that are no objects are passed over and do not count.  A document that ends
inside a string, an object or an array is reported as broken; its complete
records are returned, the one it breaks off in is not.  Columns that are not
selected are not parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from logprism.functions.formats import parse_iso
from logprism.session import store
from logprism.sources.exports import RECORD_FIELDS

#: Depth of the members of an array of the top-level object.
MEMBERS = 2
ESCAPE = re.compile(rb"\\.", re.DOTALL)
STRING = re.compile(rb'"[^"]*"?')
STRUCTURE = re.compile(rb"[\[\]{]")
DATA = re.compile(rb'"data"\s*:\s*\[')
BLANK = b", \t\r\n"

DELTAS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()),
                    ("quotes", pa.int64()), ("plain", pa.int64()), ("quoted", pa.int64())])
DELTAS_DDL = "file string, block long, size long, bytes long, quotes long, plain long, quoted long"
COUNTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("before", pa.int64()), ("ended", pa.bool_()),
                    ("begins", pa.bool_()), ("after", pa.int64()), ("ended_after", pa.bool_()), ("head", pa.binary()),
                    ("rest", pa.binary())])
COUNTS_DDL = ("file string, block long, before long, ended boolean, begins boolean, after long, ended_after boolean, "
              "head binary, rest binary")
RECORDS = pa.schema([("file", pa.string()), ("record_idx", pa.int64()), ("text", pa.binary())])
RECORDS_DDL = "file string, record_idx long, text binary"
#: The state of a range that begins a document and reads on to its end; the driver keeps those of other ranges only.
USUAL_STATE = (False, 0, True)
USUAL = "not in_string and depth = 0 and unclosed"
USUAL_PLACE = f"{USUAL} and not inside and may_begin and first_record = 0"
BATCH_BYTES = 4 << 20


class Scan:
    """String state and depth from fragment to fragment, each of which a closing brace ends."""

    def __init__(self, in_string: bool, depth: int = 0):
        self.in_string, self.depth, self.low, self.quotes = in_string, depth, depth, 0

    def feed(self, fragment: bytes, brace: bool = True) -> None:
        plain = ESCAPE.sub(b"__", fragment) if b"\\" in fragment else fragment
        parts = plain.split(b'"')
        outside = b'"'.join(parts[self.in_string::2])
        if b"]" in outside:
            for mark in STRUCTURE.findall(outside):
                self.depth += 1 if mark != b"]" else -1
                self.low = min(self.low, self.depth)
        else:
            self.depth += outside.count(b"{") + outside.count(b"[")
        self.quotes += len(parts) - 1
        self.in_string ^= bool((len(parts) - 1) & 1)
        if brace and not self.in_string:
            self.depth -= 1
            self.low = min(self.low, self.depth)

    def data_begins(self, fragment: bytes) -> int | None:
        """Place behind the bracket of a top-level ``"data": [`` in the next fragment."""
        plain = ESCAPE.sub(b"__", fragment)
        for found in DATA.finditer(plain):
            before = Scan(self.in_string, self.depth)
            before.feed(plain[:found.start()], False)
            if not before.in_string and before.depth == MEMBERS - 1:
                return found.end()
        return None


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, size, value``: the text between closing braces, by byte range and in order within it."""
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The fragments of one range after another."""
    rows = (row for batch in batches for row in zip(
        batch["file"].to_pylist(), batch["block"].to_pylist(), batch["size"].to_pylist(), batch["value"].to_pylist()))
    row = next(rows, None)
    while row is not None:
        key = row[:3]

        def values() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[:3] == key:
                yield row[3]
                row = next(rows, None)

        mine = values()
        yield key, mine
        for _ in mine:  # what the caller has left
            pass


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def depth_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First scan: one row a range."""
    for key, values in by_block(batches):
        plain, quoted, size = Scan(False), Scan(True), 0
        for value in values:
            plain.feed(value)
            quoted.feed(value)
            size += len(value) + 1
        yield rows_of(DELTAS, [(*key, size, plain.quotes, plain.depth, quoted.depth)])


def _before() -> WindowSpec:
    """The ranges of a file before each of its ranges."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def states(blocks: DataFrame) -> DataFrame:
    """The state in which each range of a file begins, and whether the file is complete: running sums in the order of the file."""
    whole, before = Window.partitionBy("file"), _before()
    # nothing follows the last fragment
    over = F.sum("bytes").over(whole) > F.col("size")
    quotes, all_quotes = F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.sum("quotes").over(whole)
    rows = blocks.withColumns({"in_string": quotes % 2 == 1, "_open": all_quotes % 2 == 1, "_over": over,
                               "_last": F.col("block") == F.max("block").over(whole)})
    change = F.when(F.col("in_string"), F.col("quoted")).otherwise(F.col("plain"))
    rows = rows.withColumn("_change", change).withColumns({
        "depth": F.coalesce(F.sum("_change").over(before), F.lit(0)), "_depth": F.sum("_change").over(whole)})
    return rows.select(
        "file", "block", "in_string", "depth", (F.col("_last") & F.col("_over")).alias("unclosed"),
        (~F.col("_open") & (F.col("_depth") + F.col("_over").cast("long") == 0)).alias("complete"))


def members(values: Iterator[bytes], state: tuple, inside: bool, may_begin: bool) -> Iterator[tuple[str, bytes]]:
    """What happens in a range: ``begin``, ``record`` (its text), ``end`` of the array, ``rest`` behind the last record."""
    in_string, depth, unclosed = state
    scan, held, brace = Scan(in_string, depth), [], True
    value = next(values, None)
    while value is not None:
        following = next(values, None)
        brace = following is not None or not unclosed
        if may_begin and b'"data"' in value and (at := scan.data_begins(value)) is not None:
            if inside:
                yield "end", b""
            scan.feed(value[:at], False)
            value, inside, may_begin, held = value[at:], True, False, []
            yield "begin", b""
        scan.low = scan.depth
        scan.feed(value, brace)
        if inside:
            held.append(value)
            if scan.low < MEMBERS:
                inside, held = False, []
                yield "end", b""
            elif brace and not scan.in_string and scan.depth == MEMBERS:
                yield "record", b"}".join(held) + b"}"
                held = []
        value = following
    if held:
        yield "rest", b"}".join(held) + (b"}" if brace else b"")


def without_other_members(text: bytes) -> bytes:
    """An object's text without commas and members that are no objects before it."""
    text = text.lstrip(BLANK)
    if not text.startswith(b"{"):
        blank = STRING.sub(lambda m: b"_" * len(m[0]), ESCAPE.sub(b"__", text))
        text = text[max(blank.find(b"{"), 0):]
    return text


def by_state(batches: Iterator[pa.RecordBatch], known: dict, usual: tuple) -> Iterator[tuple]:
    for (file, block, _), values in by_block(batches):
        yield file, block, known.get((file, block), usual), values


def record_counts(parts: DataFrame, known: dict) -> DataFrame:
    """Second scan: one row a range."""
    shared = parts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, state, values in by_state(batches, shared.value, USUAL_STATE):
            n, ended, begins, head, rest = [0, 0], [False, False], False, None, None
            for kind, text in members(values, state, state[1] >= MEMBERS, True):
                if kind == "record" and not begins and not n[0]:
                    head = text
                elif kind == "rest":
                    rest = text
                begins = begins or kind == "begin"
                n[begins] += kind == "record"
                ended[begins] = ended[begins] or kind == "end"
            yield rows_of(COUNTS, [(file, block, n[0], ended[0], begins, n[1], ended[1], head, rest)])

    return parts.mapInArrow(count, COUNTS_DDL)


def places(blocks: DataFrame) -> DataFrame:
    """Whether each range of a file begins in the array, and with which record."""
    whole, before = Window.partitionBy("file"), _before()
    rows = blocks.withColumn("_begun", F.coalesce(F.max("begins").over(before), F.lit(False)))
    # the array goes on behind the range that it begins in, up to the first range that it ends in
    first = F.col("begins") & ~F.col("_begun")
    rows = rows.withColumn("inside", F.col("_begun") & F.coalesce(
        F.max(first & ~F.col("ended_after")).over(before) & ~F.max(F.col("_begun") & F.col("ended")).over(before), F.lit(False)))
    rows = rows.withColumn("_ends", F.when(first, F.col("after")).when(F.col("inside"), F.col("before")).otherwise(0))
    return rows.select(
        "file", "block", "in_string", "depth", "unclosed", "complete", "inside", (~F.col("_begun")).alias("may_begin"),
        F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("first_record"),
        F.when(F.max("begins").over(whole), F.sum("_ends").over(whole)).otherwise(-1).alias("records"))


def export_ranges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored tables with one row for each range of each file.

    The first has its state, its first record, and the file's number of records
    (-1: no array); the second its counts and the texts at its edges.
    """
    parts = fragments(spark, path)
    begins = store(states(parts.mapInArrow(depth_changes, DELTAS_DDL)), "states")
    # one row for each range that is not like that of a small sound document
    known = {(r.file, r.block): (r.in_string, r.depth, r.unclosed) for r in begins.filter(f"not ({USUAL})").collect()}
    counts = store(record_counts(parts, known), "counts")
    counted = begins.join(counts.drop("head", "rest"), ["file", "block"])
    return store(places(counted), "ranges"), counts


def export_completeness(ranges: DataFrame) -> DataFrame:
    """Per file: ``file, ranges, has_data, records, is_complete``.

    ``is_complete`` is false where the document breaks off or its brackets do not match.
    """
    return ranges.groupBy("file").agg(
        F.count("*").alias("ranges"), (F.max("records") >= 0).alias("has_data"),
        F.greatest(F.max("records"), F.lit(0)).alias("records"), F.bool_and("complete").alias("is_complete"))


def edge_records(ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """The records at the ranges' edges, put together: ``file, record_idx, text``."""
    rows = ranges.join(counts, ["file", "block"])
    begins = F.col("may_begin") & F.col("begins")
    head = F.when(F.col("inside") & (F.col("before") > 0), F.struct(
        F.col("first_record").alias("record_idx"), F.lit(0).alias("at"), F.lit(True).alias("closed"), F.col("head").alias("text")))
    number = F.when(begins, F.col("after")).otherwise(F.col("first_record") + F.col("before"))
    rest = F.when((begins | (F.col("inside") & ~F.col("ended"))) & F.col("rest").isNotNull(), F.struct(
        number.alias("record_idx"), F.lit(1).alias("at"), F.lit(False).alias("closed"), F.col("rest").alias("text")))
    parts = rows.select("file", "block", F.explode(F.array_compact(F.array(head, rest))).alias("_p")).select("file", "block", "_p.*")
    parts = parts.groupBy("file", "record_idx").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts"), F.max("closed").alias("closed"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [without_other_members(b"".join(p["text"] for p in some)) for some in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["file"], batch["record_idx"], pa.array(whole, pa.binary())], schema=RECORDS)

    return parts.filter("closed").drop("closed").mapInArrow(join, RECORDS_DDL)


def record_texts(spark: SparkSession, path: str, ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """Third scan: ``file, record_idx, text`` of every complete record."""
    known = {(r.file, r.block): ((r.in_string, r.depth, r.unclosed), r.inside, r.may_begin, r.first_record)
             for r in ranges.filter(f"not ({USUAL_PLACE})").collect()}
    shared = spark.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for file, block, (state, inside, may_begin, number), values in by_state(batches, shared.value, (USUAL_STATE, False, True, 0)):
            edge = inside  # the first record that ends here may have begun in an earlier range
            for kind, text in members(values, state, inside, may_begin):
                if kind == "begin":
                    edge, number = False, 0
                elif kind == "record":
                    if not edge:
                        rows.append((file, number, without_other_members(text)))
                        size += len(text) + 100
                    number, edge = number + 1, False
                if size >= BATCH_BYTES:
                    yield rows_of(RECORDS, rows)
                    rows, size = [], 0
        if rows:
            yield rows_of(RECORDS, rows)

    whole = fragments(spark, path).mapInArrow(cut, RECORDS_DDL).unionByName(edge_records(ranges, counts))
    return whole.withColumn("text", F.col("text").cast("string"))


def read_split_export(spark: SparkSession, path: str, require_data: bool = True) -> DataFrame:
    """The rows of ``read_export``, read by byte ranges; ``path`` is a file, a folder or a glob of uncompressed files."""
    ranges, counts = export_ranges(spark, path)
    if require_data:
        lacking = export_completeness(ranges).filter("not has_data").select("file").take(3)
        if lacking:
            raise ValueError(f"no data section in {', '.join(r.file for r in lacking)}")
    parsed = record_texts(spark, path, ranges, counts).withColumn("_r", F.from_json("text", RECORD_FIELDS))
    return parsed.select("file", "record_idx", parse_iso(F.col("_r.timestamp")).alias("log_ts"), "_r.*")
