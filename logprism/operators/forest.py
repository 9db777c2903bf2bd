"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Fit: a tree's sample are the rows with the smallest hashes of record and tree.
One scan keeps, by a cut on that same hash, a few more candidates than needed,
and only these are shuffled, whatever the table's size.  Trees that come out
short widen the cut, so the cut never changes the sample.  Each tree is built
in its own task.  The result is a node table of at most trees x (2 x 256 - 1)
rows: a bound set by the options, so it may be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logprism.functions import fixed
from logprism.session import store

#: Candidates above the sample size, in standard deviations of their number.
SPARE_DEVIATIONS = 5.0
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, "
    "left_node int, right_node int, size int, depth int"
)
EULER = 0.5772156649
#: Rows that walk the trees at a time.
WALK_ROWS = 4096


def average_path(n):
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def sample_rows(df: DataFrame, record_id: str, rows: int, trees: int, size: int, seed: int) -> DataFrame:
    """``size`` rows per tree, or all, without replacement: columns of ``df`` plus ``tree`` and ``_rank``.

    A tree's rows are those with the smallest hashes; ties go by record.
    """
    def draw(tree: Column) -> Column:
        return F.xxhash64(F.col(record_id), tree, F.lit(seed))

    wanted = min(size, rows)
    share = min(1.0, (wanted + SPARE_DEVIATIONS * math.sqrt(wanted) + 1) / max(rows, 1))
    while True:
        cut = F.lit(min(int(-2 ** 63 + share * 2 ** 64), 2 ** 63 - 1))
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: draw(tree) <= cut)
        candidates = store(df.withColumn("tree", F.explode(chosen)), "candidates")
        counts = candidates.groupBy("tree").agg(F.count("*").alias("n")).agg(
            F.count("*").alias("trees"), F.min("n").alias("least")).first()
        if share >= 1.0 or (counts["trees"] == trees and counts["least"] >= wanted):
            break
        share = min(1.0, 2 * share)
    order = Window.partitionBy("tree").orderBy(draw(F.col("tree")), F.col(record_id))
    return candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)


def _grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree: (node, feature, threshold, left, right, size, depth)."""
    nodes: list[tuple] = []
    open_nodes = [(0, np.arange(len(points)), 0)]
    issued = 1
    while open_nodes:
        node, members, depth = open_nodes.pop()
        block = points[members]
        low, high = block.min(axis=0), block.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or not len(splittable):
            nodes.append((node, -1, 0.0, node, node, len(members), depth))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = block[:, feature] <= threshold
        nodes.append((node, feature, threshold, issued, issued + 1, len(members), depth))
        open_nodes.append((issued, members[goes_left], depth + 1))
        open_nodes.append((issued + 1, members[~goes_left], depth + 1))
        issued += 2
    return nodes


def fit_forest(
    df: DataFrame, features: Sequence[str], record_id: str, rows: int,
    trees: int = fixed.TREES, size: int = fixed.SAMPLE_PER_TREE, seed: int = fixed.SEED,
) -> DataFrame:
    """Node table of a forest over standardised features without gaps."""
    size = min(size, rows)
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    vector = F.array(*[F.col(c).cast("double") for c in features]).alias("_x")
    sample = sample_rows(df.select(F.col(record_id), vector), record_id, rows, trees, size, seed)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_rank")  # arrival order must not matter
        tree = int(part["tree"].iloc[0])
        nodes = _grow(np.stack(part["_x"].to_numpy()), limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(
            nodes,
            columns=["node", "feature", "threshold", "left_node", "right_node", "size", "depth"],
        )
        out.insert(0, "tree", tree)
        return out

    return sample.select("tree", "_rank", "_x").groupBy("tree").applyInPandas(build, NODE_SCHEMA)


@dataclass(frozen=True)
class Forest:
    """Flat node arrays of all trees; sizes depend on the options only."""

    features: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    levels: int
    norm: float

    @staticmethod
    def from_nodes(nodes: DataFrame, features: Sequence[str]) -> Forest:
        table = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
        sizes = table.groupby("tree").size()
        starts = sizes.cumsum() - sizes
        base = table["tree"].map(starts).to_numpy()
        sample = float(table.loc[table["node"] == 0, "size"].mean())  # the same for all trees
        return Forest(
            tuple(features),
            np.maximum(table["feature"].to_numpy(), 0),
            table["threshold"].to_numpy(),
            table["left_node"].to_numpy() + base,
            table["right_node"].to_numpy() + base,
            table["depth"].to_numpy() + average_path(table["size"].to_numpy()),
            starts.to_numpy(),
            int(table["depth"].max()),
            float(average_path([max(sample, 2)])[0]),
        )

    def score_matrix(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1]; a leaf points at itself, so all walks have equal length."""
        total = np.zeros(len(x))
        children = np.stack([self.left, self.right], axis=1).ravel()
        for start in range(0, len(x), WALK_ROWS):  # these rows and the nodes stay in the processor's cache
            part = np.ascontiguousarray(x[start:start + WALK_ROWS])
            values, first = part.ravel(), np.arange(len(part)) * part.shape[1]
            paths = total[start:start + WALK_ROWS]
            for root in self.roots:
                at = np.full(len(part), root)
                for _ in range(self.levels):
                    right = ~(values.take(first + self.feature.take(at)) <= self.threshold.take(at))
                    at = children.take(2 * at + right)
                paths += self.path.take(at)
        return np.power(2.0, -total / (len(self.roots) * self.norm))


    def shuffle_changes(self, x: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Per feature, the sum of the absolute changes of the rows' scores when that feature alone is taken from ``other``.

        A tree's path changes only from a node on that tests the feature and
        where the two values go different ways.  So each row walks a tree once,
        and again only from the first such node of a feature.
        """
        # a block of a shuffle has about WALK_ROWS rows and is not cut
        step, width = 2 * WALK_ROWS, x.shape[1]
        sums = np.zeros(width)
        children = np.stack([self.left, self.right], axis=1).ravel()
        inner = self.left != np.arange(len(self.left))
        last = np.empty(min(len(x), step) * width, np.int64)
        for start in range(0, len(x), step):
            part, values = (np.ascontiguousarray(a[start:start + step]).ravel() for a in (x, other))
            first = np.arange(0, len(part), width)
            total, change = np.zeros(len(first)), np.zeros(len(part))
            for root in self.roots:
                at, turns = np.full(len(first), root), []
                for _ in range(self.levels):
                    place, limit = first + self.feature.take(at), self.threshold.take(at)
                    right = ~(part.take(place) <= limit)
                    turned = np.flatnonzero((right == (values.take(place) <= limit)) & inner.take(at))
                    turns.append((place[turned], children.take(2 * at.take(turned) + ~right.take(turned))))
                    at = children.take(2 * at + right)
                path = self.path.take(at)
                total += path
                # from the deepest turns to the first ones, so that a feature's first turn is its last entry
                ends = np.cumsum([len(side) for side, _ in reversed(turns)])
                place, at = (np.concatenate(side) for side in zip(*reversed(turns)))
                last[place] = np.arange(len(place))
                keep = last.take(place) == np.arange(len(place))
                ends = np.concatenate([[0], np.cumsum(keep)])[ends]
                place, at = place[keep], at[keep]
                row = place // width
                begin, value = row * width, values.take(place)
                for done in ends[:-1]:  # those that have turned at the last level are at their leaf, and so on
                    some = slice(done, None)
                    node = at[some]
                    tested = begin[some] + self.feature.take(node)
                    taken = np.where(tested == place[some], value[some], part.take(tested))
                    at[some] = children.take(2 * node + ~(taken <= self.threshold.take(node)))
                change[place] += self.path.take(at) - path.take(row)
            share = -1.0 / (len(self.roots) * self.norm)
            before = np.power(2.0, share * total)
            place = np.flatnonzero(change)
            gaps = np.abs(np.power(2.0, share * (total.take(place // width) + change[place])) - before.take(place // width))
            sums += np.bincount(place % width, gaps, width)
        return sums


def forest_score(df: DataFrame, forest: Forest, output: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score (high = unusual) of standardised features."""
    shared = df.sparkSession.sparkContext.broadcast(forest)  # bounded by the options

    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series(model.score_matrix(batch.to_numpy(dtype=float)))

    return df.withColumn(output, walk(F.struct(*[F.col(c).cast("double") for c in forest.features])))


def decision(score: Column, offset: float) -> Column:
    """Signed distance to the cut: negative means anomaly."""
    return -score - F.lit(offset)


def predict(df: DataFrame, offset: float, score: str = "anomaly_score") -> DataFrame:
    """Add ``decision`` (low = unusual) and ``prediction`` (-1 anomaly, 1 normal)."""
    return df.withColumn("decision", decision(F.col(score), offset)).withColumn(
        "prediction", F.when(F.col("decision") < 0, -1).otherwise(1)
    )
