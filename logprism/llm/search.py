r"""Ranked lexical search of a stated set of items by dense blocked matrix multiplication.

Terms are runs of ASCII letters and digits and of any characters beyond ASCII;
A-Z are lower-cased.  One scan turns every whole text into its length and the
counts of those terms that some item holds, which is stored; corpus statistics
(``N`` documents with a term, ``L`` terms, document frequencies) come from that
table.  A second scan multiplies.  Items stand in blocks, each with a compact
vocabulary of its own, cut into tiles; a tile of document impacts (integers
below 10^6) times a tile of item weights (integers, written in digits of 20
bits, usually one) is one float64 product.  A tile has at most 2048 terms, so
no partial sum reaches 2^53 and the product is exact; tiles are added as 64-bit
integers.

A task keeps, for each item, the best ``k`` documents so far: a new document
stays if its score is at least that of the k-th, and equal scores go by
doc_id, so ties at the edge are decided exactly.  Tasks return k rows an item
at most, which are ranked in two levels.

Documents: a null or empty text has no terms and is in no result and no
statistic.  Rows that repeat are documents each; a null doc_id ranks after all
others of its score.  Items: the distinct rows of (item_id, text); a null
item_id is an item like others; an item without terms has no results.  Without
documents, or without items, the result is empty.  Other columns are not read.
An item set of more than ``ITEM_BYTES`` of text is taken in several passes, so
driver and tasks never hold more than that.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logprism.llm.common import arrow_rows, binary, store

TOP = 20
#: Terms of a tile, items of a block, and bits of a weight's digit: 2^11 * 2^20 * 10^6 < 2^53.
TILE_TERMS = 2048
BLOCK_ITEMS = 256
DIGIT_BITS = 20
#: Text of the items that one pass takes.
ITEM_BYTES = 64 << 20
#: Parts that the tasks' results are ranked in before the last ranking.
PARTS = 64

#: Byte -> byte: letters, digits and all bytes beyond ASCII stay, A-Z are lower-cased, the rest is a space.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                     ("counts", pa.list_(pa.int64()))])
VECTORS_DDL = "doc_id long, n long, terms array<int>, counts array<long>"
HITS = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
HITS_DDL = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of the documents with a term: all terms counted in n, the vocabulary's one by one."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = known.value.get, max(len(known.value), 1)
        for batch in batches:
            lengths, found = [], []
            for text in binary(batch["text"]).to_pylist():
                words = terms_of(text)
                lengths.append(len(words))
                ids = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                found.append(ids[ids >= 0] + (len(lengths) - 1) * size)
            keys, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            ends = np.searchsorted(keys, np.arange(len(lengths) + 1) * size).astype(np.int32)
            whole = arrow_rows(VECTORS, [
                batch["doc_id"], lengths, pa.ListArray.from_arrays(ends, pa.array((keys % size).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))])
            yield whole.filter(pa.array(np.array(lengths, np.int64) > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(vectors, VECTORS_DDL)


class ItemBlock:
    """Weights of a block of items over its compact vocabulary, as tiles of digit matrices."""

    def __init__(self, first: int, items: list[Counter], weights: list[int]):
        self.first, self.width = first, len(items)
        self.terms = np.array(sorted({t for item in items for t in item}), np.int64)
        place = {t: k for k, t in enumerate(self.terms.tolist())}
        matrix = np.zeros((len(self.terms), len(items)), np.int64)
        for column, item in enumerate(items):
            for term, count in item.items():
                matrix[place[term], column] = count * weights[term]
        mask = (1 << DIGIT_BITS) - 1
        self.tiles = []
        for low in range(0, len(self.terms), TILE_TERMS):
            tile = matrix[low:low + TILE_TERMS]
            digits, shift = [], 0
            while (tile >> shift).any():
                digits.append((shift, ((tile >> shift) & mask).astype(np.float64)))
                shift += DIGIT_BITS
            self.tiles.append((low, len(tile), digits))

    def scores(self, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_rows: int) -> np.ndarray:
        """Exact scores, documents by items, of the impacts at (rows, terms)."""
        total = np.zeros((n_rows, self.width), np.int64)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        held = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        rows, at, impacts = rows[held], at[held], impacts[held]
        for low, size, digits in self.tiles:
            mine = (at >= low) & (at < low + size)
            dense = np.zeros((n_rows, size), np.float64)
            dense[rows[mine], at[mine] - low] = impacts[mine]
            for shift, digit in digits:
                total += (dense @ digit).astype(np.int64) << shift
        return total


def impacts_of(counts: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated term counts of documents with n terms, in 64-bit integers."""
    if 25 * int(n.max(initial=0)) * n_docs < 1 << 62:
        length = (25 * n * n_docs) // n_terms
    else:
        length = np.array([25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
    return (1_000_000_000 * counts) // (1000 * counts + 12 * (75 + length))


class Best:
    """The k best (score, doc_id) of each item of a block, as rows arrive."""

    def __init__(self, width: int, k: int):
        self.k, self.least = k, np.ones(width, np.int64)
        self.rows = tuple(np.empty(0, np.int64) for _ in range(4))  # item, -score, null id, id

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        at, item = np.nonzero(scores >= self.least)
        if not len(at):
            return
        new = (item, -scores[at, item], absent[at], ids[at])
        rows = [np.concatenate(pair) for pair in zip(self.rows, new)]
        order = np.lexsort(rows[::-1])
        rows = [column[order] for column in rows]
        starts = np.searchsorted(rows[0], np.arange(len(self.least)))
        rank = np.arange(len(order)) - starts[rows[0]]
        self.rows = tuple(column[rank < self.k] for column in rows)
        last = rank == self.k - 1
        self.least[rows[0][last]] = -rows[1][last]


def best_documents(vectors: DataFrame, blocks: list[ItemBlock], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc_id, score``: each task's k best documents of each item."""
    shared = vectors.sparkSession.sparkContext.broadcast(blocks)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [(block, Best(block.width, k)) for block in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch["counts"].flatten().to_numpy(zero_copy_only=False)
            terms = batch["terms"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(batch["terms"].offsets.to_numpy())
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            n = batch["n"].to_numpy(zero_copy_only=False)
            impacts = impacts_of(counts, n[rows], n_docs, n_terms)
            absent = batch["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            for block, best in tiles:
                best.add(block.scores(rows, terms, impacts, batch.num_rows), ids, absent)
        for block, best in tiles:
            item, score, absent, ids = best.rows
            yield arrow_rows(HITS, [
                (item + block.first).astype(np.int32), pa.array(ids, pa.int64(), mask=absent.astype(bool)), -score])

    return vectors.mapInArrow(multiply, HITS_DDL)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` and keeps the first k of each item; parts first, so no task reads all of an item's rows."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = hits.withColumn("_part", F.spark_partition_id() % PARTS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_part").orderBy(*order)))
    part = part.filter(F.col("rank") <= k).drop("rank", "_part")
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return whole.filter(F.col("rank") <= k)


def search_pass(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """``item, doc_id, score, rank`` for a bounded list of items (item_id, text)."""
    counted = [Counter(terms_of(text.encode() if text else None)) for _, text in items]
    words = sorted({word for item in counted for word in item})
    vocabulary = {word: number for number, word in enumerate(words)}
    vectors = store(term_vectors(docs, vocabulary), "vectors")
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").count()
    weights = [0] * len(words)
    for row in held.collect():  # a row for each term of the items at most
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
    by_number = [Counter({vocabulary[word]: n for word, n in item.items()}) for item in counted]
    blocks = [ItemBlock(low, by_number[low:low + BLOCK_ITEMS], weights) for low in range(0, len(items), BLOCK_ITEMS)]
    return ranked(best_documents(vectors, blocks, n_docs, n_terms, k), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    items = items.select(F.col("item_id").cast("long"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = 1 + size // item_bytes
    results = []
    for turn in range(passes):
        mine = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn)
                .orderBy("item_id", "text").collect()]
        names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(mine)], "item int, item_id long")
        results.append(search_pass(docs, mine, k).join(F.broadcast(names), "item"))  # at most one row for each collected item
    return reduce(DataFrame.unionByName, results).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
