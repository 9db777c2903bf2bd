"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source has a target number of words.  The whole mix is cut into blocks of
``block_words`` words; the blocks go to the sources by the highest quotients
``target / (2k + 1)``, and those of a source go on to its shards in the same
way, by their words.  A shard is one or more seeded documents laid end to end;
its quota of blocks is taken from its own blocks: each of them as often as all
fit, and the rest by a seeded one-to-one map of the block numbers.  A document
is taken for the words it shares with the blocks, so parts and repeats are
counted exactly and no join with the blocks is needed.

Sources are ranked by code point, the null source last; a source without words
gets nothing.  A null text has no words.  Rows with the same id count each on
their own.  Every choice hangs on ids, sizes and the seed alone, so reruns
agree.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.llm.common import key_hash, store, word_count

#: Words of a block, and of a shard at about the most.
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 18
#: Primes above any number of blocks in a shard; one steps through a shard's blocks.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579)


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns in which null equals null; the key columns are the left side's."""
    right = right.select(*[F.col(c).alias(f"_right_{c}" if c in on else c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(right, condition, how).drop(*[f"_right_{c}" for c in on])


def capped_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``target`` to the rows (source, source_size).

    Level filling: all sources get ``weight * level``, but none more than
    ``cap * source_size``.  Sorted by the level at which they reach the cap,
    the sources before the level's place are full; so one running sum gives
    the level that resharing the excess again and again would end at.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn(
        "weight", F.get(cycle, (F.row_number().over(
            Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(after))
    # the first source, in that order, that the level leaves below its cap
    return (
        ranked.withColumn("_level", level)
        .withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") < F.col("limit"), F.struct(
            F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "_level"))).over(whole)["_level"])
        .withColumn("target", F.when(F.col("_level").isNull(), F.col("limit"))
                    .otherwise(F.least(F.col("limit"), F.col("_level") * F.col("weight"))))
        .select("source", "source_size", "target")
    )


def sainte_lague(parties: DataFrame, group: Sequence[str], votes: str, seats: str, order: Column,
                 out: str) -> DataFrame:
    """Adds ``out``: the seats of each party when its group's ``seats`` go to the highest quotients.

    With n parties and V votes, the last quotient that wins lies between
    V / (2 seats + n) and V / (2 seats - n).  What is above goes to its party
    at once; only the quotients between, about two per party, are ranked.
    Ties go by ``order``, then to the earlier quotient.
    """
    whole = Window.partitionBy(*group)
    total, n = F.sum(votes).over(whole), F.count("*").over(whole)
    scaled = parties.withColumns({"_total": total, "_n": n})
    at = F.col(votes) / F.col("_total")
    sure = F.greatest(F.lit(0), F.floor(at * (2 * F.col(seats) - F.col("_n")) / 2 + 0.5) - 1).cast("long")
    last = (F.floor(at * (2 * F.col(seats) + F.col("_n")) / 2 + 0.5) + 1).cast("long")
    scaled = (
        scaled.withColumn("_sure", F.when(F.col("_total") > 0, sure).otherwise(F.lit(0).cast("long")))
        .withColumn("_last", F.when(F.col("_total") > 0, last).otherwise(F.lit(0).cast("long")))
        .withColumn("_order", order)
    )
    open_seats = F.col(seats) - F.sum("_sure").over(whole)
    scaled = scaled.withColumn("_open", open_seats)
    quotients = (
        scaled.filter(F.col(votes) > 0)
        .withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_last"))))
        .withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
    )
    best = Window.partitionBy(*group).orderBy(F.col("_q").desc(), "_order", "_k")
    won = (
        quotients.withColumn("_rank", F.row_number().over(best)).filter("_rank <= _open")
        .groupBy(*group, "_order").agg(F.count("*").alias("_won"))
    )
    joined = join_same(scaled, won, [*group, "_order"], "left")
    return joined.select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, cap: float = 2.0, seed: str = "mix",
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for rows ``doc_id, source, size``.

    ``share`` is the mix's size as a part of all words, ``cap`` how often a
    source may be repeated at most (a whole number of repeats is kept by every
    document when ``cap`` is whole).
    """
    sizes = store(docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "mix")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = capped_targets(sources, weights, share, cap)
    whole = Window.partitionBy()
    targets = targets.withColumn("seats", F.round(F.sum("target").over(whole) / block_words).cast("long"))
    targets = targets.withColumn("_all", F.lit(0))
    targets = store(sainte_lague(
        targets, ["_all"], "target", "seats", F.struct(F.col("source").isNull(), "source"), "blocks"
    ).select("source", "source_size", "target", "blocks"), "mix")

    placed = join_same(sizes, targets, ["source"])
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    placed = placed.withColumn("shard", F.pmod(key_hash(f"{seed}-shard", F.col("doc_id")), shards))
    group = ["source", "shard"]
    placed = placed.withColumn("_place", key_hash(f"{seed}-place", F.col("doc_id")))
    along = Window.partitionBy(*group).orderBy("_place", "doc_id", "size")
    placed = (
        placed.withColumn("end", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("size")).drop("_place")
    )
    quotas = sizes_by_shard(sizes, targets, shards, seed)
    quotas = sainte_lague(quotas, ["source"], "shard_size", "blocks", F.col("shard"), "quota")
    quotas = quotas.select("source", "shard", "shard_size", "quota")
    joined = join_same(placed, quotas, group, "left")

    count = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)).cast("long")
    quota = F.least(F.coalesce("quota", F.lit(0)), count * int(cap))
    steps = F.array(*[F.lit(s).cast("long") for s in STEPS])
    draw = key_hash(f"{seed}-blocks", F.col("source"), F.col("shard"))
    joined = joined.withColumns({
        "_count": count, "_every": F.floor(quota / count).cast("long"), "_some": quota % count,
        "_step": F.get(steps, F.pmod(draw, F.lit(len(STEPS))).cast("int")) % count,
        "_from": F.pmod(draw, count),
    })

    def words_of(block: Column) -> Column:
        inside = F.least(F.col("end"), (block + 1) * block_words) - F.greatest(F.col("start"), block * block_words)
        chosen = (block * F.col("_step") + F.col("_from")) % F.col("_count") < F.col("_some")
        return inside * (F.col("_every") + F.when(chosen, 1).otherwise(0))

    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))
    taken = F.when(F.col("size") > 0, F.aggregate(
        blocks, F.lit(0).cast("long"), lambda total, block: total + words_of(block))).otherwise(F.lit(0).cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def sizes_by_shard(sizes: DataFrame, targets: DataFrame, shards: Column, seed: str) -> DataFrame:
    """``source, blocks, shard, shard_size`` from the narrow table, combined before the shuffle."""
    marked = join_same(sizes, targets, ["source"]).withColumn(
        "shard", F.pmod(key_hash(f"{seed}-shard", F.col("doc_id")), shards))
    return marked.groupBy("source", "shard").agg(
        F.max("blocks").alias("blocks"), F.sum("size").alias("shard_size"))


def documents_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix of a table of documents; ``size`` is the number of words of the whole text."""
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), (3, 1, 2), **options)
