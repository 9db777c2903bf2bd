"""Features looked up from counts over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.operators.ordered import attach
from logprism.session import store


def process_table(df: DataFrame, process: str = "process_name") -> DataFrame:
    """One row per process: dense rank of its count (rarest = 1) and share of rows.

    The rank runs over the *distinct counts*, not over the processes: k
    different counts need at least k(k+1)/2 rows, so this unpartitioned window
    holds at most sqrt(2 x rows) rows.
    """
    counts = (
        df.filter(F.col(process).isNotNull()).groupBy(process).agg(F.count("*").alias("_n"))
    )
    sizes = counts.groupBy("_n").agg((F.count("*") * F.col("_n")).alias("_rows"))
    ranked = sizes.select(
        "_n",
        F.row_number().over(Window.orderBy("_n")).cast("double").alias("process_rank"),
        F.sum("_rows").over(Window.partitionBy()).alias("_total"),
    )
    return attach(counts, ranked, ["_n"]).select(
        process, "process_rank", (F.col("_n") / F.col("_total")).alias("process_frequency")
    )


def process_features(df: DataFrame, process: str = "process_name") -> DataFrame:
    """Add ``process_rank`` and ``process_frequency``; null for an absent process.

    The table of processes is stored first, so its size is known when the join
    is planned: a small one is broadcast without moving the rows, and only a
    large one costs a shuffle, in which AQE splits a hot process.
    """
    return df.join(store(process_table(df, process), "processes"), process, "left")
