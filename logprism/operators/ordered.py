"""Running sums and neighbours along one global order, without one big task.

A window over the whole table would put all rows on one task.  Both helpers
here cut the axis into pieces, work inside the pieces in parallel, and carry
one summary row per piece to the next level.

* ``running_sum`` / ``neighbours`` cut an integer axis (microseconds, record
  numbers) into blocks of 2**24 positions (16.8 s of microseconds).  Rows are
  unique per key and position, so no block can hold more than 2**24 small rows
  however dense the data is.  The level above has one row per block and is cut
  again, 4096 blocks to a piece; the last level has one row per piece, about
  460 for a year of logs, whatever the number of rows.
* ``ranged_running_sum`` is for axes without such a bound (doubles).  Spark's
  range partitioner balances the pieces by sampling; rows are unique per key
  and position, so there is no hot value.  The partitioned rows are
  checkpointed, so the sums and the offsets see the same pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.session import pin

#: Bits of the positions of one block, and of the blocks of one piece above.
BLOCK_BITS = 24
PIECE_BITS = 12
LEVELS = 2


def attach(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join; the right side has one row per key and no key is null."""
    return left.join(right, list(on), "left")


def running_sum(
    df: DataFrame, axis: str, sums: Sequence[str], keys: Sequence[str] = (),
    inclusive: bool = True, levels: int = LEVELS,
) -> DataFrame:
    """Replace each column of ``sums`` by its running total along ``axis``.

    ``df`` holds one row per (keys, axis), the columns keys, axis, sums, and
    no null keys.  An exclusive total leaves out the row itself.
    """
    keys = list(keys)
    block = f"_block{levels}"
    if levels:
        df = df.withColumn(block, F.shiftright(axis, BLOCK_BITS if levels == LEVELS else PIECE_BITS))
    groups = [*keys, block] if levels else keys
    order = (
        Window.partitionBy(*groups).orderBy(axis)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    inside = df.withColumns({c: F.coalesce(F.sum(c).over(order), F.lit(0)) for c in sums})
    if not levels:
        return inside
    totals = df.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in sums])
    before = running_sum(totals, block, sums, keys, False, levels - 1).select(
        *groups, *[F.col(c).alias(f"_off_{c}") for c in sums]
    )
    return (
        attach(inside, before, groups)
        .withColumns({c: F.col(c) + F.col(f"_off_{c}") for c in sums})
        .drop(block, *[f"_off_{c}" for c in sums])
    )


def neighbours(
    df: DataFrame, axis: str, payload: str, keys: Sequence[str] = (), levels: int = LEVELS
) -> DataFrame:
    """Add ``prev_value`` and ``next_value``: the payload of the row before and after.

    ``df`` holds one row per (keys, axis), the columns keys, axis, payload,
    and no null keys.
    """
    keys = list(keys)

    def lag_lead(frame: DataFrame, before: str, after: str, by: list[str], along: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(along)
        return frame.withColumns(
            {"prev_value": F.lag(before).over(order), "next_value": F.lead(after).over(order)}
        )

    def walk(frame: DataFrame, along: str, first: str, last: str, depth: int) -> DataFrame:
        if depth == 0:
            return lag_lead(frame, last, first, keys, along)
        block = f"_block{depth}"
        frame = frame.withColumn(block, F.shiftright(along, BLOCK_BITS if depth == LEVELS else PIECE_BITS))
        inside = lag_lead(frame, last, first, [*keys, block], along)
        edges = frame.groupBy(*keys, block).agg(
            F.min_by(first, along).alias("_first"), F.max_by(last, along).alias("_last")
        )
        outer = walk(edges, block, "_first", "_last", depth - 1).select(
            *keys, block,
            F.col("prev_value").alias("_outer_prev"), F.col("next_value").alias("_outer_next"),
        )
        return (
            attach(inside, outer, [*keys, block])
            .withColumns({
                "prev_value": F.coalesce("prev_value", "_outer_prev"),
                "next_value": F.coalesce("next_value", "_outer_next"),
            })
            .drop(block, "_outer_prev", "_outer_next")
        )

    return walk(df, axis, payload, payload, levels)


def ranged_running_sum(
    df: DataFrame, axis: str, sums: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``cum_<c>`` (running total) and ``total_<c>`` per key, for any sortable axis.

    ``df`` holds one row per (keys, axis) and no null keys.
    """
    keys = list(keys)
    pieces = pin(df.repartitionByRange(*keys, axis).withColumn("_piece", F.spark_partition_id()))
    order = (
        Window.partitionBy("_piece", *keys).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = pieces.withColumns({f"cum_{c}": F.sum(c).over(order) for c in sums})
    # one row per piece and key
    per_piece = pieces.groupBy("_piece", *keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_piece.select(
        "_piece", *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    return (
        attach(inside, offsets, ["_piece", *keys])
        .withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_off_{c}") for c in sums})
        .drop("_piece", *[f"_off_{c}" for c in sums])
    )
