"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit values.

A text's shingles (five words in a row; all words if there are fewer; no
shingle without a word) are hashed once.  The top bits of a hash name its bin,
and a bin keeps its smallest hash.  An empty bin takes the value of another:
each bin walks over all bins in an order of its own (a pairwise independent
permutation) and stops at the first that is not empty.  ``VALUE_BITS`` low bits
of each bin's mixed value are stored, one hexadecimal digit a bin; likeness
takes the share of equal digits and corrects it for those equal by chance.

Texts without a word have the fingerprint of no digits: their likeness to each
other is 1, and to any other text 0.  Words are lower-cased runs between ASCII
white space.  A null text is an empty one.

``compared_with_next`` puts documents in order of descending doc_id (nulls
last, equal ids by the text's hash) without a global window: ids are cut into
spans of about ``SPAN_ROWS`` documents, and the first document of a span is
also sent, as a guest, to the span that comes before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.operators.ordered import neighbours
from logprism.session import store

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
VALUE_BITS = 4
SPAN_ROWS = 2048
SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column) -> Column:
    """Hashes of the shingles, in order and with repeats."""
    trimmed = F.regexp_replace(text, rf"\A{SPACE}|{SPACE}\z", "")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(trimmed), SPACE))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(
            *[F.get(h, i + j) for j in range(SHINGLE)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def bin_of(h: Column) -> Column:
    """The top bits, from 0."""
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of every bin that has one, in the order of the hashes."""
    return let(F.sort_array(hashes), lambda s: F.filter(
        s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))


def factors() -> list[int]:
    """For bin j, its walk's place of bin b is ``(b - j) * factor[j]`` mod BINS, with an odd factor."""
    state, out = 0x9E3779B9, []
    for _ in range(BINS):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((state >> 40) % BINS | 1)
    return out


def densified(minima: Column) -> Column:
    """A value for each bin from the minima; empty if there are none."""
    factor = F.lit(factors())

    def filled(m: Column, bins: Column) -> Column:
        def borrowed(j: Column) -> Column:
            places = F.transform(bins, lambda b: F.pmod((b - j) * F.get(factor, j), F.lit(BINS)))
            return let(places, lambda p: F.array_position(p, F.array_min(p)))

        def value(j: Column) -> Column:
            own = F.array_position(bins, j)
            return F.get(m, F.when(own > 0, own).otherwise(borrowed(j)).cast("int") - 1)

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)

    return F.when(F.size(minima) == 0, F.array().cast("array<bigint>")).otherwise(
        let(minima, lambda m: let(F.transform(m, lambda h: bin_of(h).cast("int")), lambda bins: filled(m, bins))))


def packed(values: Column) -> Column:
    """One hexadecimal digit for each bin; the bin is mixed in, so that a borrowed value has digits of its own."""
    digit = (1 << VALUE_BITS) - 1
    return F.array_join(F.transform(values, lambda v, j: F.substring(
        F.lit("0123456789abcdef"), F.xxhash64(v, j).bitwiseAND(F.lit(digit)).cast("int") + 1, F.lit(1))), "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null."""
    return packed(densified(bin_minima(shingle_hashes(text))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1."""
    chance = 2.0 ** -VALUE_BITS
    share = (equal_digits(a, b) / BINS - chance) / (1 - chance)
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(
        F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def equal_digits(a: Column, b: Column) -> Column:
    """At how many places two strings of ``BINS`` hexadecimal digits agree, 8 digits at a time."""
    counts = []
    for start in range(1, BINS + 1, 8):
        words = [F.conv(F.substring(x, start, 8), 16, 10).cast("long") for x in (a, b)]
        other = words[0].bitwiseXOR(words[1])
        # fold each digit's bits onto its lowest one
        folded = reduce(Column.bitwiseOR, [F.shiftright(other, k) for k in range(4)])
        counts.append(F.lit(8) - F.bit_count(folded.bitwiseAND(F.lit(0x11111111))))
    return reduce(Column.__add__, counts)


def spans(docs: DataFrame) -> DataFrame:
    """Adds ``_span`` and ``_guest`` to rows with a doc_id; guests follow the span's own rows.

    After a span's own rows come the first row of the next one, or of the
    highest span after the lowest.
    """
    low, high, rows = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = 1 if low is None else max(1, (high - low) * SPAN_ROWS // max(rows, 1) + 1)
    span = F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    first = docs.groupBy(span.alias("axis")).agg(F.max("doc_id").alias("first"))
    first = store(first.withColumn("first", F.struct("axis", "first")), "spans")
    placed = neighbours(first, "axis", "first", levels=0)
    highest = first.agg(F.max_by("first", "axis")).scalar()
    guests = store(placed.select(
        F.col("axis").alias("_to"), F.coalesce("prev_value", highest).alias("_next")).select(
        "_to", F.col("_next.axis").alias("_axis"), F.col("_next.first").alias("_first")), "spans")
    own = docs.withColumn("_span", span)
    joined = own.join(guests, (F.col("_span") == F.col("_axis")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    homes = F.array(F.struct(F.col("_span").alias("span"), F.lit(False).alias("guest")))
    visits = F.array(F.struct(F.col("_to").alias("span"), F.lit(True).alias("guest")))
    return joined.withColumn("_at", F.explode(
        F.when(F.col("_to").isNull(), homes).otherwise(F.concat(homes, visits)))).select(
        *docs.columns, F.col("_at.span").alias("_span"), F.col("_at.guest").alias("_guest"))


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last third of the code points replaced by as many
    (or all) of the first of the next document's.
    """
    rows = spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "n_chars": F.length("text").cast("long")})
    order = Window.partitionBy("_span").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_hash")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    rows = rows.withColumn("_edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut).cast("int")),
        F.substring(F.col("_next"), F.lit(1), cut)))
    rows = rows.select(
        "doc_id", "_span", "_guest", "_hash", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("_edited")).alias("edited_fingerprint"))
    rows = rows.withColumn("_after", F.lead("fingerprint").over(order)).filter(~F.col("_guest"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_after")).alias("near_next"))
