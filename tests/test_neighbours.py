"""Approximate neighbours against the exact ones, and outlier factors of rows outside the fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logprism.operators import lof
from logprism.operators import neighbours as graphs
from logprism.session import run_dir, store


def table(spark, x):
    names = [f"f{i}" for i in range(x.shape[1])]
    frame = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], ", ".join(["id long", *[f"{n} double" for n in names]]))
    return store(frame, "rows"), names


def clusters(n, width, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, width)) * 3
    return middle[rng.integers(0, 12, n)] + rng.normal(size=(n, width))


def exact(x, k):
    gaps = graphs.distances(x, x)
    np.fill_diagonal(gaps, np.inf)
    return np.argsort(gaps, axis=1)[:, :k]


def test_recall_and_pairs_that_grow_with_the_points(spark):
    """Four times the points take about four times the pairs, where all pairs would be sixteen times as many."""
    n, k, pairs = 2000, 10, {}
    for size in (500, n):
        x = clusters(size, 24)
        frame, names = table(spark, x)
        graph = graphs.neighbour_graph(store(lof.collapse(frame, "id", names), "points"), k)
        pairs[size] = graph.pairs
    found = {}
    for r in graph.edges.collect():
        found.setdefault(r.point, set()).add(r.other)
    true = exact(x, k)
    recall = sum(len(found[i] & set(true[i].tolist())) for i in range(n)) / (n * k)
    assert all(len(f) == k for f in found.values())
    assert recall >= 0.95 and pairs[n] < 6 * pairs[500]


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    points = store(rows.select(F.col("embedding").cast("array<double>").alias("x"), "vec_id").groupBy("x").agg(
        F.min("vec_id").alias("point"), F.count("*").alias("copies")), "points")
    graph = graphs.neighbour_graph(points, 10)
    collected = points.collect()
    ids = [r.point for r in collected]
    true = exact(np.array([r.x for r in collected]), 10)
    wanted = {ids[i]: {ids[j] for j in row} for i, row in enumerate(true.tolist())}
    hits = sum(r.other in wanted[r.point] for r in graph.edges.collect())
    assert hits / (10 * len(ids)) >= 0.9


def test_factors_near_the_exact_ones_and_new_rows(spark):
    x = clusters(1500, 8, seed=3)
    x[:5] += 40
    frame, names = table(spark, x)
    near = {r.id: r.lof for r in lof.local_outlier_factor(frame, names, "id", k=15).collect()}
    scored, model = lof.graph_outlier_factor(frame, names, "id", k=15)
    got = {r.id: (r.lof, r.prediction) for r in scored.collect()}
    errors = [abs(got[i][0] - near[i]) for i in near]
    assert np.mean(errors) < 0.02 and all(got[i][1] == -1 for i in range(5))
    path = run_dir(spark, "model")
    model.save(path)
    loaded = lof.OutlierModel.load(spark, path)
    rng = np.random.default_rng(9)
    new = np.vstack([x[5:205] + rng.normal(size=(200, 8)) * 1e-3, rng.normal(size=(5, 8)) + 300])
    rows, _ = table(spark, new)
    fresh = {r.id: (r.lof, r.prediction) for r in lof.score_new_rows(rows, names, "id", loaded).collect()}
    assert len(fresh) == 205 and all(fresh[i][1] == -1 and fresh[i][0] > 5 for i in range(200, 205))
    # a new row beside a fitted one has nearly its factor
    assert np.median([abs(fresh[i][0] - got[i + 5][0]) for i in range(200)]) < 0.1


def test_copies_ties_and_few_rows(spark):
    frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate([0] * 30 + [1, 2, 2, 3, 50])], "id long, f double")
    scored, _ = lof.graph_outlier_factor(frame, ["f"], "id", k=3)
    exact_ = {r.id: r.lof for r in lof.local_outlier_factor(frame, ["f"], "id", k=3).collect()}
    assert {r.id: r.lof for r in scored.collect()} == pytest.approx(exact_)
    two = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, f double")
    assert lof.graph_outlier_factor(two, ["f"], "id", k=20)[0].count() == 2


def test_distances_to_pivots_are_taken_in_blocks():
    """A batch of 20,000 rows against all pivots made matrices of 330 MB each, several at a time."""
    for rows, pivots in ((20000, lof.MAX_PIVOTS), (20000, 90), (3, 4 * lof.BLOCK), (0, 5)):
        blocks = list(lof._blocks(rows, pivots))
        assert [k for b in blocks for k in range(b.start, b.stop)] == list(range(rows))
        assert all((b.stop - b.start) * pivots <= max(lof.BLOCK, pivots) for b in blocks)


@pytest.mark.parametrize("kind", ["usual", "ties", "far", "few", "odd"])
def test_nearest_pairs_by_matrix_product_are_the_exact_ones(monkeypatch, kind):
    """The product only rules out pairs: neighbours, ties and distances are those of all differences."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    if kind == "ties":
        x = np.round(x[:, :16] / 2)
    elif kind == "far":
        x = x * 1e-3 + 1e6
    elif kind == "few":
        x = x[:4]
    elif kind == "odd":
        x[5, 3], x[7, 0] = np.nan, np.inf
    ids = np.arange(len(x))
    left, other = x[:100], ids[:100][:, None] != ids[None, :]
    found = [a.tolist() for a in lof._nearest_pairs(left, x, 10, other)]
    near = lof._near_pairs(left, x, 10, other)
    if kind == "usual":
        assert len(near[0]) < 12 * len(left)  # nearly all pairs are ruled out
    monkeypatch.setattr(lof, "WIDE", 1000)
    assert found == [a.tolist() for a in lof._nearest_pairs(left, x, 10, other)] and found[0]
