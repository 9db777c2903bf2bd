"""Benchmark decontamination with the CGK embedding and bit-sampling LSH.

Which documents hold a passage within a few word edits of a benchmark item?
Texts and items are sequences of words: lower-cased (A-Z), with ASCII
punctuation read as white space.

* Windows have the size of an item.  An item of n words with at most k edits
  keeps one of any k + 1 disjoint pieces as it is, so only the windows whose
  place fits a whole piece (give or take k words) can be near; all others are
  passed over without loss.
* A window and an item are embedded by the same random walk (CGK): it writes
  the word it stands on and goes on to the next word or stays, by a random bit
  of step and word.  Sequences at a small edit distance get embeddings at a
  small Hamming distance.  Each table samples a few steps of a walk; the number
  of tables follows from the wanted recall and the share of steps on which
  sequences at the limit still agree.
* A window that meets an item in any table is verified: the smallest edit
  distance of the item to any part of the text around the window, exactly.

An exact passage agrees on every step, so it is found with certainty; recall
below that is a matter of the walks alone.

Items of fewer than ``MIN_WORDS`` words, and null ones, are too short to show
anything and are not looked for.  Items with the same id are searched each;
the best one is reported.  A null or empty text holds nothing.  Rows with the
same doc_id are one document in the result.  Benchmarks are taken in blocks of
about ``BLOCK_WORDS`` words, each searched in all documents, which bounds what
is sent to tasks; so any size works.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logprism.llm.common import WordHashes, arrow_rows, binary, mix, rolling
from logprism.session import store

MIN_WORDS = 5
SIMILARITY = 0.8
BLOCK_WORDS = 1 << 20
#: Wanted recall at the limit of the edits, and the share of steps on which an item and such a text agree.
RECALL = 0.99
AGREEMENT = 0.3
SAMPLED = 2
TABLES_PER_WALK = 6
#: The share of agreeing steps falls as items grow; of longer ones every window that holds a piece is verified.
WALK_WORDS = 100
SIEVE_BITS = 20

FOUND = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()),
                   ("item_words", pa.int32()), ("start", pa.int64())])
FOUND_DDL = "doc_id long, text_key long, item_id long, distance int, item_words int, start long"

_PLAIN = bytes(ord(chr(b).lower()) if 65 <= b < 91 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_HASHES = WordHashes()
_NEXT = np.uint64(6364136223846793005)


def words_of(text: bytes | None) -> np.ndarray:
    words = text.translate(_PLAIN).split() if text else []
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def edits_allowed(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def tables_for(recall: float, agreement: float, sampled: int) -> int:
    """Tables that are needed so that one agrees on all its steps with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agreement ** sampled))


class Walks:
    """Random walks over word sequences, and the steps that each table samples."""

    def __init__(self, tables: int, sampled: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.walks = -(-tables // TABLES_PER_WALK)
        self.salt, self.factor = (draw.integers(0, 2 ** 63, (self.walks, 1), dtype=np.uint64) | np.uint64(1) for _ in "sf")
        self.steps = draw.random((self.walks, TABLES_PER_WALK, sampled))

    def keys(self, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Keys of the windows of n words, one row per window and one column per table.

        Past the end of the window or of the words a walk stands on an empty word.
        """
        steps = (self.steps * 2 * n).astype(np.int64)
        wanted = {int(step): None for step in np.unique(steps)}
        padded = np.append(words, np.uint64(0))
        ends = np.minimum(starts + n, len(words))
        at = np.repeat(starts[None, :], self.walks, axis=0)
        salt = self.salt.copy()
        for step in range(2 * n):
            word = padded[np.where(at < ends, at, len(words))]
            if step in wanted:
                wanted[step] = word
            at = at + (((word ^ salt) * self.factor) >> np.uint64(63)).astype(np.int64)
            salt = salt * _NEXT + np.uint64(1)
        out = []
        for w in range(self.walks):
            for table in steps[w]:
                key = np.zeros(len(starts), np.uint64)
                for step in table:
                    key = mix(key * np.uint64(3) + wanted[int(step)][w] + np.uint64(1))
                out.append(key)
        return np.stack(out, axis=1)


class Index:
    """Pieces and keys of the items of one block."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, recall: float):
        self.walks = Walks(tables_for(recall, AGREEMENT, SAMPLED), SAMPLED)
        self.items, self.pieces = [], {}
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            n = len(words)
            if n < MIN_WORDS:
                continue
            k = edits_allowed(n, similarity)
            keys = self.walks.keys(words, np.zeros(1, np.int64), n)[0]
            bounds = [j * n // (k + 1) for j in range(k + 2)]
            for start, end in zip(bounds, bounds[1:]):
                code = int(rolling(words[start:end], end - start)[0])
                pieces.setdefault(end - start, []).append((code, len(self.items), start))
            self.items.append((item_id, words, k, keys))
        for size, rows in pieces.items():
            rows.sort()
            codes = np.array([r[0] for r in rows], np.uint64)
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(codes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
            self.pieces[size] = sieve, codes, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def fits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the places where they would begin, for every whole piece that the words hold."""
        items, begins = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, (sieve, codes, owner, offset) in self.pieces.items():
            found = rolling(words, size)
            at = np.flatnonzero(sieve[(found >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
            low, high = (np.searchsorted(codes, found[at], side) for side in ("left", "right"))
            many = high - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            row = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            items.append(owner[row])
            begins.append(np.repeat(at, many) - offset[row])
        return np.concatenate(items), np.concatenate(begins)


def distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of the item to a part of the text, and where that part ends."""
    m = len(text)
    steps = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    for i, word in enumerate(item):
        change = np.empty(m + 1, np.int64)
        change[0] = i + 1
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=change[1:])
        row = np.minimum.accumulate(change - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def passages(index: Index, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """item_id, distance, item_words, about where it starts, for the items that a text's words hold."""
    owner, begin = index.fits(words)
    if not len(owner):
        return
    best: dict[int, tuple[int, int, int]] = {}
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    for number in np.unique(owner):
        item_id, item, k, keys = index.items[number]
        n = len(item)
        begins = np.unique(begin[owner == number])
        starts = np.unique((begins[:, None] + np.arange(-k, k + 1)).ravel())
        starts = starts[(starts >= 0) & (starts < len(words))]
        if not len(starts):
            continue
        if n <= WALK_WORDS:
            starts = starts[(index.walks.keys(words, starts, n) == keys).any(axis=1)]
        done = -1
        for start in starts:
            if start <= done:
                continue
            low, high = max(0, start - k), min(len(words), start + n + 2 * k)
            distance, end = distance_within(item, words[low:high])
            done = start + k
            if distance <= k:
                got = (distance, n, max(low, low + end - n))
                best[item_id] = min(best.get(item_id, got), got)
    for item_id, (distance, n, start) in best.items():
        yield item_id, distance, n, start


def found_passages(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                   recall: float = RECALL) -> DataFrame:
    """``doc_id, text_key, item_id, distance, item_words, start``: the items that each row of documents holds."""
    spark = docs.sparkSession
    items = store(benchmark.filter("text is not null").select("item_id", "text"), "benchmark")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / (6 * BLOCK_WORDS)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = None
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        ready = spark.sparkContext.broadcast(Index(
            sorted(((r.item_id, r.text.encode()) for r in mine), key=lambda x: (x[0] is None, x[0] or 0, x[1])),
            similarity, recall))

        def run(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), binary(batch["text"])):
                    for row in passages(ready.value, words_of(text.as_py())):
                        out.append((doc_id, key, *row))
                if out:
                    yield arrow_rows(FOUND, list(zip(*out)))

        part = rows.mapInArrow(run, FOUND_DDL)
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
                 recall: float = RECALL) -> DataFrame:
    """``doc_id, item_id, distance, item_words, start``: the items that each document holds.

    ``distance`` counts words inserted, left out or changed, ``start`` is the
    number of the word at which the passage begins, within the edits.  One row
    per doc_id and item_id, either of which may be null, the nearest passage.
    """
    found = found_passages(docs, benchmark, similarity, recall)
    best = F.min(F.struct("distance", "start", "item_words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("_best")).select(
        "doc_id", "item_id", "_best.distance", "_best.item_words", "_best.start")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Rows go by doc_id, null or not, and text: another text with the same id stays.
    """
    found = found_passages(docs, benchmark, **options).select("doc_id", "text_key").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_key"]), "left_anti")
