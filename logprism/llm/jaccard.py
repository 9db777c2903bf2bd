"""N-gram Jaccard join with signature trees.

Which texts have a Jaccard similarity of at least ``similarity`` between their
sets of word shingles, and which texts hang together by such links?  Equal sets
are one class, so copies are not paired.

1. Every class has a signature: a bitmap of its shingles, about eight bits for
   each, and its size.
2. A pair above the similarity must share a shingle among the first few of
   each, in any fixed order of all shingles.  The order puts shingles that many
   texts share last; how many share one comes from a table of counters of a
   fixed size over all texts.  Such a shared shingle is a bucket, and the
   bucket's smallest class is its root.
3. Every class is compared with the roots of its buckets.  This takes a row for
   each class and root, and joins most copies of a text into one component.
4. Roots whose classes are still in several components get signature trees.
   Leaves hold classes of like size, nodes the union of their bitmaps, their
   range of sizes and of components.  A traversal of two trees at once leaves
   out pairs of nodes whose sizes or whose largest possible overlap rule the
   similarity out, and those within one component.  Large roots are cut into
   blocks of like size, and trees of blocks that can hold pairs are traversed
   against each other in their own tasks; so a root may have any number of
   classes.  What is left is verified on the whole sets.

Nothing is capped: all classes and all pairs between components that the bounds
allow are looked at.  A signature tree over the whole corpus cannot prune: the
union of a few hundred unrelated texts covers any bitmap that is worth holding,
so roots come from shared shingles, and trees work below them.

Shingles and classes are told apart by 64-bit hashes.  A text of fewer words
than a shingle has one, of all its words; a text without a word has none, and
neither has a null text.  Every row stands for its text, also where ids repeat;
a row without doc_id is linked as others are, but cannot name a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logprism.llm.common import (
    SLOTS_DDL, arrow_rows, binary, connected_components, hashed_words, mix, reduce_slots, rolling, slot_rows,
)
from logprism.session import discard, release, run_dir, store

SHINGLE = 5
PERCENT = 80
#: Bits of a signature for each shingle, and counters of the shingle table.
BITS_PER_SHINGLE = 8
COUNTERS = 1 << 20
SLOT_COUNT = 16
#: Classes of a block at about the most, and children of a node.
BLOCK = 256
FAN = 2
#: Bits of the filter before the join that fetches shingle sets.
FILTER_BITS = 1 << 24

SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("bits", pa.binary()),
                    ("slot", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
SIGNED_DDL = "doc_id long, text_key long, n_shingles long, class long, bits binary, slot int, part int, data binary"
#: First shingles are shuffled in so many blocks, a power of two, by rows that a task makes of about so many at once.
KEY_BLOCKS = 1024
PACK = 500_000
PACKED = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("classes", pa.binary())])
PACKED_DDL = "block int, keys binary, classes binary"
STARS = pa.schema([("class", pa.int64()), ("root", pa.int64())])
STARS_DDL = "class long, root long"
#: Meetings of blocks are held in so many rounds, each for a part of the roots, so that no more bitmaps are shuffled at once.
MEETING_ROUNDS = 4
SETS = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])
SETS_DDL = "class long, shingles binary"
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS_DDL = "a long, b long"


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = hashed_words(text)
    if len(words) == 0:
        return np.empty(0, np.uint64)
    found = rolling(words, size) if len(words) >= size else rolling(words, len(words)) ^ np.uint64(len(words))
    return np.unique(found)


def class_of(shingles: np.ndarray) -> int:
    """Signed hash of a set."""
    total = np.uint64(len(shingles))
    with np.errstate(over="ignore"):
        total = mix(np.array([total + mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]))
    return int(total.view(np.int64)[0])


def least_overlap(n, m, percent: int = PERCENT):
    """Smallest overlap of sets of sizes n and m that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def bits_for(n: int) -> int:
    """Signature length of a set of n: a power of two of at least ``BITS_PER_SHINGLE`` bits each."""
    return max(64, 1 << (BITS_PER_SHINGLE * n - 1).bit_length())


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bitmap of a set, bit by bit as booleans; shorter ones are the longer ones folded."""
    bits = np.zeros(bits_for(len(shingles)), bool)
    bits[(shingles & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return bits


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """Bitmap words at a shorter length: the OR of its parts."""
    return np.bitwise_or.reduce(words.reshape(-1, length), axis=0)


def sets_of(batches: Iterator[pa.RecordBatch], size: int, *columns: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """The columns' values and the shingle set of each row."""
    for batch in batches:
        values = zip(*[batch[c].to_pylist() for c in columns]) if columns else repeat(())
        for row, text in zip(values, binary(batch["text"])):
            yield row, shingle_set(text.as_py(), size)


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def signed(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """``doc_id, text_key, n_shingles, class, bits`` of every document, how many texts have the shingles of each counter, and the table of both.

    Both come from one pass over the texts; a task's counters are rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, pending = np.zeros(COUNTERS, np.uint32), [], 0
        rows, held = [], 0
        for (doc_id, key), found in sets_of(batches, size, "doc_id", "text_key"):
            bits = np.packbits(signature(found), bitorder="little").tobytes() if len(found) else b""
            rows.append((doc_id, key, len(found), class_of(found), bits, None, None, None))
            held += len(bits) + 100
            if held > 4 << 20:
                yield arrow_rows(SIGNED, list(zip(*rows)))
                rows, held = [], 0
            waiting.append(counter_of(found))
            pending += len(found)
            if pending > COUNTERS:
                counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS).astype(np.uint32)
                waiting, pending = [], 0
        if rows:
            yield arrow_rows(SIGNED, list(zip(*rows)))
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=COUNTERS).astype(np.uint32)
        for batch in [slot_rows(counts, SLOT_COUNT)]:
            n = batch.num_rows
            yield arrow_rows(SIGNED, [*[[None] * n] * 5,
                                      batch["slot"], batch["part"], batch["data"]])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    both = store(keyed.mapInArrow(run, SIGNED_DDL), "signed")
    slots = both.filter("slot is not null").select("slot", "part", "data")
    counters = reduce_slots(slots, "uint32", saturating, SLOT_COUNT)
    return both.filter("slot is null").select("doc_id", "text_key", "n_shingles", "class", "bits"), counters, both


def saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum that stays at the highest number; only the order of magnitude is used."""
    return np.minimum(a.astype(np.uint64) + b, np.uint64(2 ** 32 - 1)).astype(np.uint32)


def prefixes(docs: DataFrame, counters: np.ndarray, size: int, percent: int) -> DataFrame:
    """``block, keys, classes``: of each set, the first shingles in the common order, among which a link must show, packed by block.

    A key is 42 bits of a shingle, ten of which are its block's number; shingles
    that have them in common only make a pair more to look at.  A row holds many
    keys of a block, four bytes each, and their classes, eight each.
    """
    # only the order of magnitude counts, so that nearly equal counters do not outweigh the hash
    rank = np.zeros(COUNTERS, np.uint8) if not len(counters) else np.log2(np.maximum(counters, 1)).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, shingles, classes, held = shared.value, [], [], 0

        def rows() -> pa.RecordBatch:
            found = mix(np.concatenate(shingles)) >> np.uint64(22)
            block = (found & np.uint64(KEY_BLOCKS - 1)).astype(np.int16)
            order = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[order], np.arange(KEY_BLOCKS + 1))
            sides = (found >> np.uint64(10)).astype(np.uint32)[order], np.concatenate(classes)[order]
            some = [k for k in range(KEY_BLOCKS) if ends[k] < ends[k + 1]]
            return arrow_rows(PACKED, [some, *[[side[ends[k]:ends[k + 1]].tobytes() for k in some] for side in sides]])

        for _, found in sets_of(batches, size):
            n = len(found)
            if not n:
                continue
            keep = n - -(-percent * n // 100) + 1
            order = (ranks[counter_of(found)].astype(np.uint64) << np.uint64(56)) | (
                mix(found) >> np.uint64(8))
            first = found[np.argpartition(order, keep - 1)[:keep]] if keep < n else found
            shingles.append(first)
            classes.append(np.full(len(first), class_of(found)))
            held += len(first)
            if held > PACK:
                yield rows()
                shingles, classes, held = [], [], 0
        if shingles:
            yield rows()

    return docs.mapInArrow(run, PACKED_DDL)


def stars_of(block: pa.Table) -> pa.Table:
    """``class, root`` of the classes that share a key with another, the root itself too: the smallest class of a key."""
    keys, classes = (np.frombuffer(b"".join(block[c].to_pylist()), t) for c, t in (("keys", np.uint32), ("classes", np.int64)))
    order = np.argsort(keys)
    keys, classes = keys[order], classes[order]
    same = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
    several = same[1:] | same[:-1]
    keys, classes = keys[several], classes[several]
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    bucket = np.cumsum(first) - 1
    low, high = classes[first], classes[np.roll(first, -1)]
    pairs = np.stack([classes, low[bucket]], axis=1)[(low < high)[bucket]]
    return pa.table(list(np.unique(pairs, axis=0).T.copy()), schema=STARS)


def words_of(bits: bytes) -> np.ndarray:
    return np.frombuffer(bits, np.uint64)


def may_reach(n: int, a: np.ndarray, m: int, b: np.ndarray, percent: int) -> bool:
    """Can the sets behind two signatures reach the similarity?

    A bit that only one of them has stands for at least one shingle that the
    other lacks.
    """
    length = min(len(a), len(b))
    a, b = (x if len(x) == length else folded(x, length) for x in (a, b))
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return most >= least_overlap(n, m, percent)


def possible(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that sizes and signatures allow; rows have ``n_a, bits_a, n_b, bits_b`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, bits, m, other = (batch[c].to_pylist() for c in ("a", "b", "n_a", "bits_a", "n_b", "bits_b"))
            keep = [may_reach(n[i], words_of(bits[i]), m[i], words_of(other[i]), percent) for i in range(len(a))]
            keep = np.flatnonzero(keep)
            yield arrow_rows(PAIRS, [batch["a"].take(pa.array(keep)), batch["b"].take(pa.array(keep))])

    sized = pairs.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return sized.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, PAIRS_DDL)


def filter_places(values: np.ndarray) -> list[np.ndarray]:
    values = values.view(np.uint64)
    return [(mix(values ^ np.uint64(salt)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for salt in (1, 2, 3)]


def bloom_filter(values: DataFrame, column: str):
    """Broadcast Bloom filter of a fixed size over a column of longs; it stands before joins, which decide."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in filter_places(batch[0].to_numpy(zero_copy_only=False)):
                bits[at] = True
        yield slot_rows(np.packbits(bits), SLOT_COUNT)

    rows = values.select(column).filter(F.col(column).isNotNull())
    packed = reduce_slots(rows.mapInArrow(mark, SLOTS_DDL), "uint8", np.bitwise_or, SLOT_COUNT)
    return values.sparkSession.sparkContext.broadcast(packed)


def held_by(shared) -> np.ndarray:
    return np.unpackbits(shared.value).astype(bool) if len(shared.value) else np.zeros(FILTER_BITS, bool)


def class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``class, shingles`` of the rows ``class, doc_id`` in ``wanted``, made again from the texts.

    Only documents that a filter of the wanted ids lets through, and those
    without an id, are read into sets.
    """
    shared = bloom_filter(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held_by(shared)
        rows, held = [], 0
        for batch in batches:
            ids = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            passed = np.logical_and.reduce([bits[at] for at in filter_places(ids)]) | ~np.asarray(
                batch["doc_id"].is_valid().to_numpy(zero_copy_only=False), bool)
            chosen = batch.take(pa.array(np.flatnonzero(passed)))
            for _, found in sets_of([chosen], size):
                if len(found):
                    rows.append((class_of(found), found.tobytes()))
                    held += found.nbytes
                if held > 4 << 20:
                    yield arrow_rows(SETS, list(zip(*rows)))
                    rows, held = [], 0
        if rows:
            yield arrow_rows(SETS, list(zip(*rows)))

    found = docs.mapInArrow(run, SETS_DDL).join(wanted, "class", "left_semi")
    return found.dropDuplicates(["class"])


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored: the pairs ``a, b`` whose whole sets reach the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = store(classes.select("class", "doc_id").join(wanted, "class", "left_semi"), "wanted")
    sets = store(class_sets(docs, wanted, size), "sets")
    discard(wanted)
    sides = pairs
    for side in ("a", "b"):
        sides = sides.join(sets.select(F.col("class").alias(side), F.col("shingles").alias(f"set_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch[c][i].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield arrow_rows(PAIRS, [batch["a"].take(rows), batch["b"].take(rows)])

    found = store(sides.mapInArrow(run, PAIRS_DDL), "edges")
    discard(sets)
    return found


class Node:
    """Classes of like size: the union of their bitmaps, their range of sizes, their component if it is one.

    ``excess`` is by how much the shingles of a member outnumber its bits at
    the most.
    """

    def __init__(self, children: list[Node], member: int = -1, n: int = 0, words=None, label=None):
        self.children, self.member = children, member
        if children:
            self.words = np.bitwise_or.reduce([c.words for c in children])
            self.low, self.high = min(c.low for c in children), max(c.high for c in children)
            self.excess = max(c.excess for c in children)
            self.label = children[0].label if all(c.label == children[0].label for c in children) else None
        else:
            self.words, self.low, self.high, self.label = words, n, n, label
            self.excess = n - int(np.bitwise_count(words).sum())


def tree(members: list[int], sizes, words, labels, length: int) -> Node:
    """A leaf for each class, by component and size, joined upwards; all bitmaps folded to one length."""
    members = sorted(members, key=lambda i: (labels[i], sizes[i]))
    nodes = [Node([], i, sizes[i], folded(words[i], length), labels[i]) for i in members]
    while len(nodes) > 1:
        nodes = [Node(nodes[k:k + FAN]) for k in range(0, len(nodes), FAN)]
    return nodes[0]


def traverse(a: Node, b: Node, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of members in different components that the bounds of no pair of nodes rule out.

    A shared shingle sets a bit in both bitmaps, so a member of a node shares
    at most its excess and one shingle for each common bit.
    """
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a.label is not None and a.label == b.label:
            continue
        if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
            continue
        most = min(a.excess, b.excess) + int(np.bitwise_count(a.words & b.words).sum())
        if most < least_overlap(a.low, b.low, percent):
            continue
        if not a.children and not b.children:
            yield a.member, b.member
        elif a is b:
            stack += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
        else:
            stack += [(x, y) for x in a.children or [a] for y in b.children or [b]]


def across_components(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Stored: pairs ``a, b`` of classes of one root and different components that the signature trees leave.

    Rows ``root, class, component``.  A root's classes are cut by size, and
    each cut into blocks; blocks of one cut or of neighbouring ones meet.  The
    bitmaps are sent only to meetings of several components.
    """
    members = members.join(classes.select("class", "n_shingles"), "class")
    # a step in size of 100 / percent: linked classes are in one step or in neighbouring ones
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    placed = members.withColumn("step", step)
    sizes = placed.groupBy("root", "step").agg(F.count("*").alias("n"))
    blocks = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    after = blocks.select("root", (F.col("step") - 1).alias("step"), F.col("blocks").alias("above"))
    before = blocks.select("root", (F.col("step") + 1).alias("step"), F.col("blocks").alias("below"))
    blocks = blocks.join(after, ["root", "step"], "left").join(before, ["root", "step"], "left")
    placed = placed.join(blocks, ["root", "step"])
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")

    def meet(step_: F.Column, i: F.Column, step2: F.Column, j: F.Column) -> F.Column:
        return F.struct(step_.alias("s1"), i.alias("b1"), step2.alias("s2"), j.alias("b2"))

    # within the cut: block i meets all blocks j >= i; across: every block of a cut meets every block of the next
    cut = F.col("step")
    inside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: meet(
        cut, F.least(own, j), cut, F.greatest(own, j)))
    up = F.when(F.col("above").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.col("above") - 1), lambda j: meet(cut, own, cut + 1, j)))
    down = F.when(F.col("below").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.col("below") - 1), lambda j: meet(cut - 1, j, cut, own)))
    none = F.array().cast("array<struct<s1:int,b1:int,s2:int,b2:int>>")
    meetings = F.concat(inside, F.coalesce(up, none), F.coalesce(down, none))
    sent = placed.withColumn("own", own).withColumn("at", F.explode(meetings)).select(
        "root", "at.s1", "at.b1", "at.s2", "at.b2", "step", "own", "class", "n_shingles", "component")
    keys = ["root", "s1", "b1", "s2", "b2"]
    # a meeting needs two components, and a class on either side
    left = (F.col("step") == F.col("s1")) & (F.col("own") == F.col("b1"))
    right = (F.col("step") == F.col("s2")) & (F.col("own") == F.col("b2"))
    sent = store(sent, "meetings")
    useful = sent.groupBy(*keys).agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"),
        F.max(left).alias("_left"), F.max(right).alias("_right")).filter("_low < _high and _left and _right").select(*keys)
    useful = store(useful, "meetings")

    def run(group: pa.Table) -> pa.Table:
        key = {k: group[k][0].as_py() for k in keys}
        sizes, classes, labels = (group[c].to_pylist() for c in ("n_shingles", "class", "component"))
        words = [words_of(b.as_py()) for b in group["bits"]]
        side = list(zip(group["step"].to_pylist(), group["own"].to_pylist()))
        left = [i for i, s in enumerate(side) if s == (key["s1"], key["b1"])]
        right = [i for i, s in enumerate(side) if s == (key["s2"], key["b2"])]
        found = []
        if left and right and len(set(labels)) > 1:
            length = min(map(len, words))
            first = tree(left, sizes, words, labels, length)
            own = (key["s1"], key["b1"]) == (key["s2"], key["b2"])
            second = first if own else tree(right, sizes, words, labels, length)
            found = [(i, j) for i, j in traverse(first, second, percent) if may_reach(
                sizes[i], words[i], sizes[j], words[j], percent)]
        return pa.table([
            pa.array([max(classes[i], classes[j]) for i, j in found], pa.int64()),
            pa.array([min(classes[i], classes[j]) for i, j in found], pa.int64())], schema=PAIRS)

    spark = classes.sparkSession
    path = run_dir(spark, "pairs")
    for part in range(MEETING_ROUNDS):
        of = F.pmod(F.xxhash64("root"), F.lit(MEETING_ROUNDS)) == part
        held = sent.filter(of).join(useful.filter(of), keys).join(classes.select("class", "bits"), "class")
        held.groupBy(*keys).applyInArrow(run, PAIRS_DDL).write.mode("append").parquet(path)
        del held
        release(spark)
    discard(sent, useful)
    pairs = spark.read.schema(PAIRS_DDL).parquet(path)
    pairs.stored_at = path
    return pairs


def class_components(
    docs: DataFrame, classes: DataFrame, counters: np.ndarray, size: int, percent: int,
) -> DataFrame:
    """``node, component`` over the classes (rows ``class, n_shingles, bits, doc_id``) that have a link."""
    stars = store(prefixes(docs, counters, size, percent).groupBy("block").applyInArrow(stars_of, STARS_DDL).distinct(), "roots")
    release(docs.sparkSession)

    def with_both(pairs: DataFrame, column: str, short: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("class").alias(side), F.col(column).alias(f"{short}_{side}")), side)
        return pairs

    # sizes rule out most pairs before any bitmap is sent
    first = stars.filter("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b"))
    first = with_both(first, "n_shingles", "n").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    first = with_both(first, "bits", "bits")
    tried = store(possible(first, percent), "pairs")
    release(docs.sparkSession)
    links = verified(tried, classes, docs, size, percent)
    found = connected_components(links)

    labelled = stars.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class"))
    labelled = store(labelled, "members")
    discard(stars)
    mixed = labelled.groupBy("root").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    rest = labelled.join(mixed.filter("_low < _high").select("root"), "root")
    pairs = across_components(rest, classes, percent)
    left = store(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(labelled, tried, pairs)
    more = verified(left, classes, docs, size, percent)
    discard(left)
    every = connected_components(links.unionByName(more))
    discard(links, more)
    return every


def labelled_documents(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, component`` of every document; sets that are linked share the component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked, counters, both = signed(docs, size)
    classes = store(marked.filter("n_shingles > 0").groupBy("class").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("bits").alias("bits"), F.min("doc_id").alias("doc_id")), "classes")
    # the bitmaps are kept once for each class, not for each document
    marked = store(marked.drop("bits"), "signed")
    discard(both)
    found = class_components(docs, classes, counters, size, percent)
    discard(classes)
    return marked.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")).drop("class")


def jaccard_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    named = labelled_documents(docs, size, percent)
    smallest = named.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(smallest, (named["component"] == smallest["component"]) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The first document of each group, with all its columns: that of the smallest id, null last, then of the smallest text hash.

    Rows go by id and text, so another text with the same id stays unless it
    is in the group itself.  Of rows equal in both any one stays.  Documents
    without words are in no group and stay.
    """
    named = store(labelled_documents(docs, size, percent).filter("n_shingles > 0").select(
        "component", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key").alias("_place")), "labelled")
    per = named.groupBy("component", "_place").agg(F.count("*").alias("_n"))
    first = named.groupBy("component").agg(F.min("_place").alias("_first"))
    places = per.join(first, "component").filter((F.col("_place") != F.col("_first")) | (F.col("_n") > 1))
    decided = store(places.select("_place.doc_id", "_place.text_key", (F.col("_place") == F.col("_first")).alias("stays")), "decided")

    def those(frame: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        same = frame["doc_id"].cast("long").eqNullSafe(rows["doc_id"]) & (F.xxhash64(frame["text"]) == rows["text_key"])
        return frame.join(rows, same, how)

    kept = those(docs, decided, "left_anti")
    repeated = decided.filter("stays")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(those(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
