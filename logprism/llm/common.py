"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logprism.session import apply_settings, discard, store

#: A word: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch.  Texts are long, so batches are kept short.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings, with batches that suit texts of any length."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(seed: str, *parts: Column) -> Column:
    """Repeatable 60-bit number of a seed and some columns, also computable in other SQL engines."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


class WordHashes(dict):
    """Word bytes -> 64-bit hash; forgets its words when there are too many of them."""

    LIMIT = 2_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def binary(column: pa.Array) -> pa.Array:
    """Strings as their UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def hashed_words(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text in order; A-Z are lower-cased."""
    words = text.lower().split() if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashed words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, size):
        out = out * _STEP + words[j:j + n]
    return mix(out)


def arrow_rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)],
        schema=schema)


SLOTS = pa.schema([("slot", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
SLOTS_DDL = "slot int, part int, data binary"


def slot_rows(array: np.ndarray, slots: int) -> pa.RecordBatch:
    """One task's array, cut into ``slots`` rows for :func:`reduce_slots`."""
    part = TaskContext.get().partitionId()
    pieces = np.split(array, slots)
    return arrow_rows(SLOTS, [list(range(slots)), [part] * slots, [p.tobytes() for p in pieces]])


def reduce_slots(rows: DataFrame, dtype: str, combine: Callable, slots: int) -> np.ndarray:
    """Combine the arrays of all tasks element by element and return the result.

    The arrays have a fixed size, which bounds what a task holds and what
    reaches the driver.  Rows are folded as they stream in, over two levels,
    so no group is ever held as a whole.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, data in zip(batch["slot"].to_pylist(), batch["data"].to_pylist()):
                array = np.frombuffer(data, dtype)
                kept[slot] = combine(kept[slot], array) if slot in kept else array.copy()
        for slot, array in kept.items():
            yield arrow_rows(SLOTS, [[slot], [0], [array.tobytes()]])

    first = rows.withColumn("part", F.pmod("part", F.lit(32))).repartition("slot", "part")
    folded = first.mapInArrow(fold, SLOTS_DDL).repartition("slot").mapInArrow(fold, SLOTS_DDL)
    pieces = {r.slot: np.frombuffer(r.data, dtype) for r in folded.collect()}
    if not pieces:
        return np.empty(0, dtype)
    return np.concatenate([pieces[k] for k in range(slots)])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: the smallest node reachable over the edges.

    Alternates large-star and small-star steps until nothing changes; every
    step is an aggregation and a join, and its result is written to the shared
    folder, and the one before removed.  Nodes without an edge to another node
    do not appear.
    """
    pairs = store(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u > v").distinct(), "links")

    def digest(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = digest(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.filter("u > v").distinct(), "links")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v")))
        before, pairs = pairs, store(small.filter("u > v").distinct(), "links")
        discard(before, large)
        now = digest(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
