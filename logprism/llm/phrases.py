r"""Phrase collocations from depth-truncated suffix subtrees, built group by group.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and
pieces into words at blanks and tabs.  All counts are per language; a null
language is ``und``, a null text empty.  A phrase is a run of 2 to ``depth``
words within a piece.

Counting goes by vertical partitioning.  A first scan counts words.  Suffixes
begin at each word and are truncated after ``depth`` words, at the end of their
piece, and before a word of fewer than ``least`` occurrences, which no candidate
can hold.  The words' counts give each prefix bucket (a range of first-word
hashes) its number of suffixes; buckets are put into groups of at most
``budget`` suffixes, and the suffixes of a bucket above it are dealt to several
groups by the words that follow.  In a second scan each task sorts its
suffixes, adds up equal ones, and sends every group its part as columns in one
value.  A group merges these parts into the leaves of its subtree, in order;
every node above is a range of leaves, and its count their total.  Nodes of a
bucket that was split add up over its groups.

A phrase cut after its first k words scores ``10^6 a^2 div (l r)``, exact in
decimals; the lowest cut counts.  Candidates inside a longer candidate that
makes up half of their occurrences are dropped, and the first ``top`` of each
language are ranked by score, a, and the phrase's bytes.

Words of a language are told apart by 64-bit hashes.  Rows that repeat count
each.  doc_id and other columns are not read.  Without words the result is
empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logprism.llm.common import arrow_rows, binary, mix, reduce_slots, slot_rows, store

DEPTH = 3
LEAST = 10
TOP = 2000
#: Of a shorter phrase's occurrences, the share in percent within one longer candidate that drops it.
INSIDE_PERCENT = 50
#: Suffixes of a group: what one task holds at most, about 40 bytes each.
BUDGET = 1 << 21
#: Words that a scan gathers before it sends them on.
GATHERED = 1 << 21
#: Ranges of first-word hashes.
BUCKETS = 1 << 16
#: Parts that a language's candidates are ranked in before the last ranking.
RANK_PARTS = 64
#: Bits of the table of frequent words: 16 for each, within these limits.  A full one only prunes less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28

#: Between two pieces, as a word of its own; it cannot be part of one.
BREAK = b"."
_SPLIT = b".,;:!?\x0a\x0b\x0c\x0d"
#: Byte -> byte: A-Z are lower-cased, all marks that split become ``BREAK``.
TEXT_BYTES = bytes(BREAK[0] if b in _SPLIT else b for b in range(256)).lower()

WORDS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
WORDS_DDL = "lang string, word binary, n long"
PARTS = pa.schema([("group", pa.int32()), ("data", pa.binary())])
PARTS_DDL = "group int, data binary"
NODES = pa.schema([("words", pa.list_(pa.int64())), ("n", pa.int64())])
NODES_DDL = "words array<long>, n long"


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text, with ``BREAK`` between pieces."""
    return text.translate(TEXT_BYTES).replace(BREAK, b" . ").split() if text else []


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, symbol, n``; a symbol is the hash of language and word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counter in counts.items():
                counter.pop(BREAK, None)
                words = list(counter)
                for low in range(0, len(words), 100_000):
                    some = words[low:low + 100_000]
                    yield arrow_rows(WORDS, [[lang] * len(some), some, [counter[w] for w in some]])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), binary(batch["text"]).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > GATHERED // 2:
                yield from rows()
        yield from rows()

    found = docs.select(_language().alias("lang"), "text").mapInArrow(count, WORDS_DDL)
    found = found.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return found.select("lang", "word", F.xxhash64("lang", "word").alias("symbol"), "n")


class Symbols(dict):
    """Word -> its symbol in a language, as ``xxhash64(lang, word)`` has it; forgets its words when there are too many."""

    LIMIT = 1_000_000

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
            self[BREAK] = 0
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value


def bits_of(symbols: np.ndarray, bits: int) -> np.ndarray:
    return (mix(symbols) & np.uint64(bits - 1)).astype(np.int64)


def frequent_bitmap(words: DataFrame, count: int) -> np.ndarray:
    """Bit table of the symbols of ``words``; it may hold others by chance, never fewer."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length())))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for batch in batches:
            table[bits_of(batch["symbol"].to_numpy(zero_copy_only=False).view(np.uint64), bits)] = True
        yield slot_rows(np.packbits(table), 16)

    parts = max(1, min(64, count // 100_000))
    table = reduce_slots(words.select("symbol").coalesce(parts).mapInArrow(fill, "slot int, part int, data binary"),
                         "u1", np.bitwise_or, 16)
    return table if len(table) else np.zeros(bits // 8, np.uint8)


def bucket_of(symbols: np.ndarray) -> np.ndarray:
    return (symbols >> np.uint64(48)).astype(np.int64)


def prefix_groups(words: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each bucket of first words.

    Buckets within the budget are put together first-fit in order of their
    hashes; one above it gets as many groups of its own as it needs.
    """
    place = F.shiftrightunsigned("symbol", 48)
    totals = np.zeros(BUCKETS, np.int64)
    for row in words.groupBy(place.alias("bucket")).agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        totals[row["bucket"]] = row["n"]
    first, width = np.zeros(BUCKETS, np.int64), np.ones(BUCKETS, np.int64)
    group, held = 0, 0
    for bucket, total in enumerate(totals.tolist()):
        if total > budget:
            group += held > 0
            first[bucket], width[bucket] = group, -(-total // budget)
            group, held = group + int(width[bucket]), 0
            continue
        if held + total > budget:
            group, held = group + 1, 0
        first[bucket] = group
        held += total
    return first, width


def leaves(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct suffixes (rows of words, 0 after the end) and their totals."""
    order = np.lexsort(columns.T[::-1])
    columns, counts = columns[order], counts[order]
    starts = np.flatnonzero(np.r_[True, (columns[1:] != columns[:-1]).any(axis=1)]) if len(columns) else order
    return columns[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def truncated_suffixes(symbols: np.ndarray, frequent: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of two words or more from each place; 0 stands for everything after the end."""
    bits = bits_of(symbols, 8 * len(frequent))
    known = (symbols != 0) & ((frequent[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).astype(bool)
    symbols = np.r_[np.where(known, symbols, np.uint64(0)), np.zeros(depth, np.uint64)]
    n = len(symbols) - depth
    columns = np.stack([symbols[j:j + n] for j in range(depth)], axis=1)
    for j in range(1, depth):
        columns[columns[:, j - 1] == 0, j] = 0
    return columns[columns[:, 1] != 0]


def suffix_parts(docs: DataFrame, frequent: np.ndarray, groups: tuple[np.ndarray, np.ndarray], depth: int) -> DataFrame:
    """``group, data``: each task's distinct suffixes with their counts, one row for each group and flush."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, *groups))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, width = shared.value
        of: dict[str, Symbols] = {}
        held: list[np.ndarray] = []

        def parts() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            suffixes = truncated_suffixes(np.concatenate(held), table, depth)
            held.clear()
            columns, counts = leaves(suffixes, np.ones(len(suffixes), np.int64))
            bucket = bucket_of(columns[:, 0])
            tail = columns[:, 1].copy()
            for j in range(2, depth):
                tail = mix(tail * np.uint64(3) + columns[:, j])
            group = first[bucket] + (mix(tail) % width[bucket].astype(np.uint64)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            names, starts = np.unique(group[order], return_index=True)
            for name, rows in zip(names.tolist(), np.split(order, starts[1:])):
                data = np.ascontiguousarray(columns[rows].T).tobytes() + counts[rows].astype("<u4").tobytes()
                yield arrow_rows(PARTS, [[name], [data]])

        size = 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), binary(batch["text"]).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                if lang not in of:
                    if len(of) > 64:
                        of.clear()
                    of[lang] = Symbols(lang)
                held.append(np.fromiter(map(of[lang].__getitem__, words), np.uint64, len(words)))
                held.append(np.zeros(1, np.uint64))
                size += len(words) + 1
                if size > GATHERED:
                    yield from parts()
                    size = 0
        yield from parts()

    return docs.select(_language().alias("lang"), "text").mapInArrow(scan, PARTS_DDL)


def subtree_nodes(columns: np.ndarray, counts: np.ndarray, least: int, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and totals of the nodes, level by level from two words on, that count.

    Where the group has not all suffixes of its prefixes, nodes above the
    leaves stay whatever their total.
    """
    depth = columns.shape[1]
    for size in range(2, depth + 1):
        inside = columns[:, size - 1] != 0
        rows, n = columns[inside, :size], counts[inside]
        if not len(rows):
            continue
        starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
        totals = np.add.reduceat(n, starts)
        kept = totals >= (least if whole or size == depth else 1)
        yield rows[starts[kept]], totals[kept]


def phrase_counts(parts: DataFrame, groups: tuple[np.ndarray, np.ndarray], depth: int, least: int) -> DataFrame:
    """``words, n`` of the phrases of two words or more that occur ``least`` times."""
    first, width = groups
    split = sorted({int(g) for f, w in zip(first[width > 1], width[width > 1]) for g in range(f, f + w)})
    shared = parts.sparkSession.sparkContext.broadcast(frozenset(split))

    def build(group: pa.Table) -> pa.Table:
        columns, counts = [], []
        for data in group["data"].to_pylist():
            n = len(data) // (8 * depth + 4)
            columns.append(np.frombuffer(data, np.uint64, depth * n).reshape(depth, n).T)
            counts.append(np.frombuffer(data, "<u4", n, 8 * depth * n).astype(np.int64))
        whole = group["group"][0].as_py() not in shared.value
        tree = leaves(np.concatenate(columns), np.concatenate(counts))
        words, totals = [], []
        for rows, n in subtree_nodes(*tree, least, whole):
            ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
            words.append(pa.ListArray.from_arrays(ends, pa.array(rows.ravel().view(np.int64))))
            totals.append(pa.array(n))
        return pa.Table.from_arrays([
            pa.chunked_array(words, pa.list_(pa.int64())), pa.chunked_array(totals, pa.int64())], schema=NODES)

    nodes = parts.groupBy("group").applyInArrow(build, NODES_DDL)
    if split:  # only then do nodes lie in several groups
        nodes = nodes.groupBy("words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return nodes


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(15,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``words, lang, a, l, r, score`` of each phrase by its lowest cut; ``words`` has the single words' counts."""
    single = words.select(F.array("symbol").alias("words"), "n", "lang")
    totals = phrases.select("words", "n", F.lit(None).cast("string").alias("lang")).unionByName(single)
    size = F.size("words")
    cuts = phrases.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"_head": F.expr("slice(words, 1, k)"), "_rest": F.expr("slice(words, k + 1, size(words))")})
    heads = totals.select(F.col("words").alias("_head"), F.col("n").alias("l"), "lang")
    rests = totals.select(F.col("words").alias("_rest"), F.col("n").alias("r"))
    cuts = cuts.join(heads, "_head").join(rests, "_rest")
    million = F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumns({"_up": million * _exact("a") * _exact("a"), "_down": _exact("l") * _exact("r")})
    cuts = cuts.withColumn("score", F.expr("_up div _down").cast("long"))
    best = cuts.groupBy("words").agg(
        F.first("a").alias("a"), F.max("lang").alias("lang"), F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    return best.select("words", "lang", "a", "_cut.l", "_cut.r", "_cut.score")


def not_inside(candidates: DataFrame, depth: int, percent: int) -> DataFrame:
    """Drops the candidates of which one longer candidate that holds them has ``percent`` of the occurrences."""
    longer = candidates.filter(F.size("words") > 2)
    at = F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))"))
    within = longer.select(F.col("a").alias("_longer"), at.alias("words"))
    within = within.groupBy("words").agg(F.max("_longer").alias("_longer"))
    return candidates.join(within, "words", "left").filter(
        F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def spelled(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``phrase``, the words joined by blanks."""
    placed = candidates.select("words", F.posexplode("words").alias("_at", "symbol")).join(words.select("symbol", "word"), "symbol")
    names = placed.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_placed"))
    names = names.select("words", F.array_join(F.transform("_placed", lambda x: x["word"].cast("string")), " ").alias("phrase"))
    return candidates.join(names, "words")


def collocations(
    docs: DataFrame, depth: int = DEPTH, least: int = LEAST, top: int = TOP, percent: int = INSIDE_PERCENT, budget: int = BUDGET,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases."""
    docs = docs.select("lang", "text")
    counts = store(word_counts(docs), "words")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counts.filter(F.col("n") >= least)
    number = words.count()
    groups = prefix_groups(words, budget)
    parts = suffix_parts(docs, frequent_bitmap(words, number), groups, depth)
    phrases = store(phrase_counts(parts, groups, depth, least), "phrases")
    candidates = store(not_inside(scored(phrases, words), depth, percent), "candidates")

    # in two levels, so that no task reads a language's rows from all others; rows tied at the edge stay
    order = [F.col("score").desc(), F.col("a").desc()]
    first = candidates.withColumn("_part", F.spark_partition_id() % RANK_PARTS)
    for keys in (("lang", "_part"), ("lang",)):
        place = F.rank().over(Window.partitionBy(*keys).orderBy(*order))
        first = first.withColumn("_rank", place).filter(F.col("_rank") <= top).drop("_rank")
    first = first.drop("_part")
    by_name = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    named = spelled(store(first, "candidates"), words).withColumn("rank", F.row_number().over(by_name).cast("long"))
    named = named.filter(F.col("rank") <= top)
    return named.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
