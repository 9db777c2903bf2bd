"""Approximate nearest neighbours by a graph that is refined by neighbours of neighbours, stored for new rows.

NN-descent (Dong, Moses, Li 2011) in Spark's terms:

1. Random hyperplanes give each point a cell in each of ``TABLES`` tables.
   Cells are cut into chunks of bounded size by a hash, and the points of a
   chunk are compared: the first graph.
2. In a round, every point is the centre of a small group: its neighbours, and
   up to as many points that have it for a neighbour.  The members of a group
   are compared with each other, unless both were there before, and every
   member keeps its nearest.  A group has at most twice ``k`` members, however
   dense the data is, so a round shuffles 2 k vectors a point and compares
   fewer than 2 k^2 pairs a point.
3. Rounds end when few neighbours change, or after ``rounds``.

The number of compared pairs is a multiple of points x k^2, not of points^2.
New rows find their cells, then walk over the graph: the neighbours of their
nearest so far are compared in each step.

Points are distinct vectors with a number of copies (``lof.collapse``).  A chosen
option, never the size of the data, decides between this and the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logprism.functions import fixed
from logprism.session import discard, store

TABLES = 4
CHUNK = 100
ROUNDS = 8
#: Neighbours kept in the rounds, as a multiple of those asked for: more of them lead to the right ones in high dimension.
WIDER = 2
#: Rounds end when fewer than this share of all neighbours is new.
FEW = 0.01
#: How many of its nearest a new row walks on from, and how often.
STARTS, STEPS = 8, 3

EDGES_DDL = "point long, other long, distance double, copies long, pairs long"
EDGES = pa.schema([("point", pa.int64()), ("other", pa.int64()), ("distance", pa.float64()), ("copies", pa.int64()), ("pairs", pa.int64())])


@dataclass(frozen=True)
class Graph:
    """Points ``point, x, copies``, their edges ``point, other, distance, copies``, and the tables' hyperplanes."""

    points: DataFrame
    edges: DataFrame
    planes: np.ndarray
    centre: np.ndarray
    pairs: int = 0

    def save(self, path: str) -> None:
        spark = self.points.sparkSession
        self.points.write.parquet(f"{path}/points")
        self.edges.write.parquet(f"{path}/edges")
        tables, bits, _ = self.planes.shape
        rows = [(t, b, self.planes[t, b].tolist()) for t in range(tables) for b in range(bits)] + [(-1, 0, self.centre.tolist())]
        spark.createDataFrame(rows, "tab int, bit int, plane array<double>").coalesce(1).write.parquet(f"{path}/planes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        rows = spark.read.parquet(f"{path}/planes").collect()  # tables x bits rows
        bits = 1 + max((r.bit for r in rows), default=0)
        centre = np.array(next(r.plane for r in rows if r.tab < 0))
        planes = np.zeros((TABLES, bits, len(centre)))
        for r in rows:
            if r.tab >= 0:
                planes[r.tab, r.bit] = r.plane
        return Graph(spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/edges"), planes, centre)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences so that small ones keep their digits."""
    out = np.zeros((len(left), len(right)))
    for low in range(0, len(left), 64):
        gaps = left[low:low + 64, None, :] - right[None, :, :]
        out[low:low + 64] = np.sqrt((gaps * gaps).sum(axis=2))
    return out


def nearest_rows(ids: np.ndarray, copies: np.ndarray, gaps: np.ndarray, k: int) -> pa.Table:
    """The k nearest others of each row of a symmetric matrix; infinite distances are no pairs."""
    np.fill_diagonal(gaps, np.inf)
    pairs = int(np.isfinite(gaps).sum()) // 2
    take = min(k, len(ids) - 1)
    if take < 1:
        return EDGES.empty_table()
    to = np.argpartition(gaps, take - 1, axis=1)[:, :take]
    found = np.take_along_axis(gaps, to, axis=1)
    at = np.repeat(np.arange(len(ids)), take)
    to, found = to.ravel(), found.ravel()
    real = np.isfinite(found)
    counted = np.zeros(int(real.sum()), np.int64)
    counted[:1] = pairs  # counted once for each group
    return pa.table([ids[at[real]], ids[to[real]], found[real], copies[to[real]], counted], schema=EDGES)


def cells(rows: DataFrame, planes: np.ndarray, centre: np.ndarray, keep: str) -> DataFrame:
    """The columns ``keep`` and ``x`` once for each table, with ``tab`` and ``cell``."""
    shared = rows.sparkSession.sparkContext.broadcast((planes, centre))
    tables, bits, _ = planes.shape
    weights = 1 << np.arange(bits, dtype=np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, middle = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"]) - middle
            for t in range(tables):
                cell = ((x @ normals[t].T > 0) * weights).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(np.full(len(cell), t), pa.int32()), pa.array(cell, pa.int64())],
                    names=[*batch.schema.names, "tab", "cell"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.select(*keep.split(), "x").dtypes)
    return rows.select(*keep.split(), "x").mapInArrow(assign, f"{schema}, tab int, cell long")


def best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each point, one row a pair, with ``fresh``: whether the pair is new."""
    order = Window.partitionBy("point").orderBy("distance", "other")
    one = edges.groupBy("point", "other").agg(
        F.min("distance").alias("distance"), F.max("copies").alias("copies"), F.min("fresh").alias("fresh"))
    return one.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def first_graph(points: DataFrame, planes: np.ndarray, centre: np.ndarray, k: int) -> DataFrame:
    placed = store(cells(points, planes, centre, "point copies"), "cells")
    sizes = placed.groupBy("tab", "cell").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    dealt = placed.join(sizes, ["tab", "cell"]).withColumn("_chunk", F.pmod(F.xxhash64("point", "tab"), "_chunks"))

    def compare(group: pa.Table) -> pa.Table:
        return nearest_rows(group["point"].to_numpy(), group["copies"].to_numpy(), distances(*[matrix(group["x"])] * 2), k)

    return dealt.groupBy("tab", "cell", "_chunk").applyInArrow(compare, EDGES_DDL)


def refined(points: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges ``point, other, distance, copies, pairs`` from one round over the graph."""
    back = Window.partitionBy("other").orderBy("distance", "point")
    turned = edges.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= k)
    members = edges.select(F.col("point").alias("centre"), F.col("other").alias("point"), "fresh").unionByName(
        turned.select(F.col("other").alias("centre"), "point", "fresh")).groupBy("centre", "point").agg(F.max("fresh").alias("fresh"))
    members = members.join(points, "point")

    def compare(group: pa.Table) -> pa.Table:
        fresh = group["fresh"].to_numpy(zero_copy_only=False).astype(bool)
        if not fresh.any():
            return EDGES.empty_table()
        gaps = distances(*[matrix(group["x"])] * 2)
        gaps[~fresh[:, None] & ~fresh[None, :]] = np.inf
        return nearest_rows(group["point"].to_numpy(), group["copies"].to_numpy(), gaps, k)

    return members.groupBy("centre").applyInArrow(compare, EDGES_DDL)


def gap(a: str, b: str) -> Column:
    """Euclidean distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def any_points(points: DataFrame) -> DataFrame:
    """``other, _x, copies`` of a few points."""
    return points.orderBy("point").limit(STARTS).select(F.col("point").alias("other"), F.col("x").alias("_x"), "copies")


def neighbour_graph(points: DataFrame, k: int, rounds: int = ROUNDS, seed: int = fixed.SEED) -> Graph:
    """The graph of the k nearest points of each stored point (``point, x, copies``)."""
    count, width = points.agg(F.count("*"), F.max(F.size("x"))).first()
    width = width or 1
    middle = points.agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(width)]).first()
    centre = np.array([v or 0.0 for v in middle], float)
    bits = max(0, int(np.ceil(np.log2(max(count, 2) / CHUNK))))
    planes = np.random.default_rng(seed).normal(size=(TABLES, bits, width))
    found = store(first_graph(points, planes, centre, WIDER * k), "graph")
    pairs = found.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    # points alone in all their cells start from any few points
    lost = points.join(found.select("point").distinct(), "point", "left_anti").select("point", "x")
    linked = lost.join(F.broadcast(any_points(points))).filter("point <> other").select(
        "point", "other", gap("x", "_x").alias("distance"), "copies")
    wide = WIDER * k  # the graph is kept wider than asked for while it is refined
    edges = store(best(found.drop("pairs").unionByName(linked).withColumn("fresh", F.lit(1)), wide), "graph")
    discard(found)
    for _ in range(rounds):
        found = store(refined(points, edges, wide), "graph")
        pairs += found.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        known = edges.withColumn("fresh", F.lit(0))
        after = store(best(known.unionByName(found.drop("pairs").withColumn("fresh", F.lit(1))), wide), "graph")
        discard(found, edges)
        edges, new = after, after.filter("fresh = 1").count()
        if new <= FEW * wide * count:
            break
    asked = store(best(edges, k).drop("fresh"), "graph")
    discard(edges)
    return Graph(points, asked, planes, centre, pairs)


def nearest_in_graph(graph: Graph, rows: DataFrame, k: int) -> DataFrame:
    """``row, other, distance, copies``: the k nearest points found for each of the rows ``row, x``."""
    there = cells(graph.points, graph.planes, graph.centre, "point copies").select(
        "tab", "cell", "point", "copies", F.col("x").alias("_x"))
    sizes = there.groupBy("tab", "cell").agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"))
    there = there.join(sizes, ["tab", "cell"]).withColumn("_chunk", F.pmod(F.xxhash64("point", "tab"), "_chunks")).drop("_chunks")
    # a row meets one chunk of its cell in each table: a bounded number of points
    asked = cells(rows, graph.planes, graph.centre, "row").join(sizes, ["tab", "cell"])
    asked = asked.withColumn("_chunk", F.pmod(F.xxhash64("row", "tab"), "_chunks")).drop("_chunks")

    def kept(found: DataFrame) -> DataFrame:
        one = found.groupBy("row", "other").agg(F.min("distance").alias("distance"), F.max("copies").alias("copies"))
        order = Window.partitionBy("row").orderBy("distance", "other")
        return one.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)

    found = asked.join(there, ["tab", "cell", "_chunk"]).select(
        "row", F.col("point").alias("other"), gap("x", "_x").alias("distance"), "copies")
    # rows whose cells are empty in all tables start from any few points
    lost = rows.join(found.select("row").distinct(), "row", "left_anti")
    found = found.unionByName(lost.join(F.broadcast(any_points(graph.points))).select("row", "other", gap("x", "_x").alias("distance"), "copies"))
    near = store(kept(found), "walk")
    vectors = graph.points.select(F.col("point").alias("other"), F.col("x").alias("_x"), "copies")
    for _ in range(STEPS):
        start = near.filter(F.col("_r") <= STARTS).select("row", F.col("other").alias("point"))
        on = start.join(graph.edges.select("point", "other"), "point").select("row", "other").distinct().join(
            near.select("row", "other"), ["row", "other"], "left_anti")
        on = on.join(vectors, "other").join(rows, "row").select("row", "other", gap("x", "_x").alias("distance"), "copies")
        before, near = near, store(kept(near.drop("_r").unionByName(on)), "walk")
        discard(before)
    return near.drop("_r")
