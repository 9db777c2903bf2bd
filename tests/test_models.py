import numpy as np
import pytest
from pyspark.sql import functions as F

from logprism.operators import evaluate as ev
from logprism.operators import forest as forest_ops
from logprism.operators import lof
from logprism.operators.scaling import Scaler, feature_vector, impute_median, impute_mode
from logprism.plans import scoring, training
from logprism.session import run_dir
from logprism.sources import model_store


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    x[:10] += 9.0  # planted outliers
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    path = run_dir(spark, "points")
    spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def model(points):
    return training.fit_features(points, ("a", "b", "c"), "id", "v1")


def scores(points, model):
    return {r["id"]: r["anomaly_score"] for r in scoring.score_features(points, model).collect()}


def test_planted_outliers_rank_first(points, model):
    got = scores(points, model)
    assert set(sorted(got, key=got.get, reverse=True)[:10]) == set(range(10))
    assert all(0 < s < 1 for s in got.values())


def test_cut_is_the_contamination_percentile(points, model):
    got = scores(points, model)
    assert model.offset == pytest.approx(np.percentile([-s for s in got.values()], 10))
    row = scoring.prediction_summary(scoring.score_features(points, model)).first()
    assert (row["anomaly_count"], row["total_samples"]) == (150, 1500)


def test_same_seed_same_trees_other_seed_other_trees(points, model):
    again = training.fit_features(points.repartition(7), ("a", "b", "c"), "id", "v2")
    key = ["tree", "node"]
    left, right = (m.nodes.toPandas().sort_values(key, ignore_index=True) for m in (model, again))
    # the scaler's sums may differ in the last bit when rows arrive in another order
    assert left.drop(columns="threshold").equals(right.drop(columns="threshold"))
    assert np.allclose(left["threshold"], right["threshold"])
    other = training.fit_features(points, ("a", "b", "c"), "id", "v3", training.Options(seed=7))
    assert not left.equals(other.nodes.toPandas().sort_values(key, ignore_index=True))


def test_tree_shape(model):
    nodes = model.nodes.toPandas()
    assert nodes["tree"].nunique() == 100 and nodes["depth"].max() <= 8
    assert nodes.groupby("tree").size().max() <= 511
    assert set(nodes.loc[nodes["node"] == 0, "size"]) == {256}
    leaves = nodes[nodes["feature"] < 0]
    assert set(leaves.groupby("tree")["size"].sum()) == {256}


def test_score_matches_a_plain_walk(points, model):
    nodes = {(r["tree"], r["node"]): r for r in model.nodes.collect()}
    row = model.scaler.transform(points).filter("id = 3").first()
    depths = []
    for tree in range(100):
        at = nodes[(tree, 0)]
        while at["feature"] >= 0:
            go = row["abc"[at["feature"]]] <= at["threshold"]
            at = nodes[(tree, at["left_node"] if go else at["right_node"])]
        depths.append(at["depth"] + float(forest_ops.average_path([at["size"]])[0]))
    want = 2 ** (-np.mean(depths) / float(forest_ops.average_path([256])[0]))
    assert scores(points, model)[3] == pytest.approx(want)


def test_average_path():
    got = forest_ops.average_path([0, 1, 2, 3, 256])
    assert list(got[:3]) == [0, 0, 1]
    assert got[3] == pytest.approx(2 * (np.log(2) + 0.5772156649) - 4 / 3)
    assert got[4] == pytest.approx(10.2448, abs=1e-3)


def test_few_rows_use_all_of_them(spark):
    df = spark.createDataFrame([(i, float(i % 9)) for i in range(40)], "id long, a double")
    nodes = forest_ops.fit_forest(df, ["a"], "id", 40, trees=5).toPandas()
    assert set(nodes.loc[nodes["node"] == 0, "size"]) == {40}


def test_constant_column_is_never_split(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(60)], "id long, a double, b double")
    nodes = forest_ops.fit_forest(df, ["a", "b"], "id", 60, trees=5).toPandas()
    assert set(nodes["feature"]) == {-1, 1}


def test_store_reload_deploy(spark, points, model):
    root = run_dir(spark, "models")
    assert model_store.read_registry(spark, root).count() == 0
    metadata = model_store.build_metadata(
        "v1", "2024-02-01T00:00:00Z", "isolation_forest", 1500, model.scaler.features, {"trees": 100},
        {"accuracy": None, "score_mean": 0.5}, {"p50": 0.4}, (3, 4), training_id="job-1")
    model_store.save_model(spark, model_store.Model("v1", model.scaler, model.nodes, model.offset, metadata), root)
    loaded = model_store.load_model(spark, root, "v1")
    assert loaded.scaler == model.scaler and loaded.offset == model.offset
    assert scores(points, loaded) == scores(points, model)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{root}/v2/metadata")
    row = model_store.read_registry(spark, root).first()
    assert (row["version"], row["status"], row["training_id"]) == ("v1", "available", "job-1")
    assert row["evaluation_info"]["basic_metrics"] == {"score_mean": 0.5}
    assert model_store.deploy_model(spark, root, "v1", "2024-02-02T00:00:00Z", "me")
    assert not model_store.deploy_model(spark, root, "v9", "2024-02-02T00:00:00Z")
    after = model_store.read_registry(spark, root).collect()
    assert [(r["status"], r["deployment_info"]["deployed_by"]) for r in after] == [("deployed", "me")]
    assert model_store.read_registry_entries(spark, root).first()["total_thresholds"] == 4

    from logprism.sources.files import storage_findings

    wanted = spark.createDataFrame([("v1",), ("v7",)], "version string")
    found = storage_findings(spark, root, f"{root}/none", f"{root}/none", wanted)
    assert sorted((r["item"], r["finding"]) for r in found.collect()) == [
        ("v2", "missing_nodes"), ("v2", "missing_scaler"), ("v7", "empty_model")]


def test_bad_options(points, model):
    with pytest.raises(ValueError, match="unsupported model type"):
        training.fit_features(points, ("a",), "id", "v", training.Options(model_type="nope"))
    with pytest.raises(ValueError, match="missing features"):
        scoring.score_features(points.drop("a"), model)
    with pytest.raises(ValueError, match="stats"):
        scoring.score_features(points, model, stats="other")


def test_training_medians_fill_gaps(spark, points):
    fitted = training.fit_features(points, ("a", "b", "c"), "id", "v", training.Options(all_medians=True))
    gap = spark.createDataFrame([(1, None, 0.0, 0.0)], "id long, a double, b double, c double")
    value = fitted.scaler.fill(gap).first()["a"]
    assert value == pytest.approx(np.median([r["a"] for r in points.collect()]))


def test_scaler_with_gaps_and_constants(spark):
    values = [1.0, None, 3.0, 10.0, None]
    df = spark.createDataFrame([(v, 2.0) for v in values], "a double, k double")
    scaler = Scaler.fit(df, ["a", "k"])
    filled = np.array([1.0, 3.0, 3.0, 10.0, 3.0])
    assert scaler.median == {"a": 3.0}
    assert scaler.mean["a"] == pytest.approx(filled.mean()) and scaler.std["a"] == pytest.approx(filled.std())
    got = scaler.transform(scaler.fill(df)).collect()
    assert [r["a"] for r in got] == pytest.approx(list((filled - filled.mean()) / filled.std()))
    assert {r["k"] for r in got} == {0.0}
    assert Scaler.from_frame(scaler.to_frame(spark)) == scaler


def test_filling(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (None, None), (4.0, None)], "n double, s string")
    assert sorted(r["n"] for r in impute_median(df, ["n"]).collect()) == [1.0, 2.0, 2.0, 4.0]
    assert sorted(r["s"] for r in impute_mode(df, ["s"]).collect()) == ["a", "a", "a", "b"]
    nothing = spark.createDataFrame([(None,)], "s string")
    assert impute_mode(nothing, ["s"]).first()["s"] == "unknown"
    with pytest.raises(ValueError, match="missing"):
        feature_vector(df, ["n", "zz"], strict=True)


@pytest.mark.parametrize("k", [5, 40])
def test_lof_matches_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lof, "CHUNK", 60)
    monkeypatch.setattr(lof, "POINTS_PER_PIVOT", 20)
    rng = np.random.default_rng(k)
    x = np.round(np.concatenate([rng.normal(size=(260, 2)), rng.normal(8, 0.3, size=(120, 2)), [[30.0, 30.0]]]), 2)
    x = np.concatenate([x, np.repeat(x[:1], 190, axis=0)])  # a third are copies of one row
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["lof"] for r in lof.local_outlier_factor(df, ["a", "b"], "id", k=k).collect()}
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    reach = np.partition(gaps, k - 1, axis=1)[:, k - 1]
    near = [np.flatnonzero(gaps[i] <= reach[i]) for i in range(len(x))]
    density = np.array([1 / (np.maximum(gaps[i, n], reach[n]).mean() + 1e-10) for i, n in enumerate(near)])
    want = [density[n].mean() / density[i] for i, n in enumerate(near)]
    assert [got[i] for i in range(len(x))] == pytest.approx(want)


def test_evaluation_against_direct_formulas(spark):
    rng = np.random.default_rng(42)
    s = np.round(rng.normal(size=800), 1)  # many ties
    y = (rng.random(800) < 0.1 + 0.3 * (s > 1)).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    curve = ev.score_curve(df)
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert ev.roc_auc(curve).first()[0] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall = (y[s >= t] == 1).sum() / len(pos)
        ap += (recall - last) * (y[s >= t] == 1).mean()
        last = recall
    assert ev.average_precision(curve).first()[0] == pytest.approx(ap)
    assert ev.threshold(curve).first()[0] == pytest.approx(np.percentile(s, 90))
    sweep = {r["percentile"]: r for r in ev.threshold_sweep(curve).collect()}
    assert sorted(sweep) == [50, 75, 80, 85, 90, 95, 99]
    for q, row in sweep.items():
        assert row["anomaly_ratio"] == pytest.approx((s > np.percentile(s, q)).mean())


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    curve = ev.score_curve(df)
    assert ev.roc_auc(curve).first()[0] is None
    assert ev.confusion(curve).count() == 4
    assert ev.classification_metrics(curve).first()["precision"] == 0.0


@pytest.mark.parametrize("passed, auc, accepted", [
    ((True, True, True, True), 0.8, True), ((True, False, True, True), 0.8, False),
    ((True, True, True, True), 0.3, False), ((True, True, True, True), None, True)])
def test_supervised_gate(spark, passed, auc, accepted):
    names = ("accuracy", "precision", "recall", "f1_score")
    rows = [(n, 0.9, 0.5, p) for n, p in zip(names, passed)] + [("roc_auc", auc, 0.5, False)]
    checks = spark.createDataFrame(rows, "check string, value double, threshold double, passed boolean")
    assert ev.gate(checks, supervised=True).first()["accepted"] is accepted


def test_folds_are_contiguous(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(13)], "id long")
    got = {r["id"] // 3: r["fold"] for r in training.assign_folds(df, "id").collect()}
    assert [got[i] for i in range(13)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_importance_and_cross_validation(spark, points, model):
    rows = training.permutation_importance(points, model, "id", rows=200, repeats=2).collect()
    assert {r["feature"] for r in rows} == {"a", "b", "c"} and all(r["importance"] > 0 for r in rows)
    folds = training.cross_validate(points, ("a", "b", "c"), "id", (F.col("id") < 10).cast("int"), folds=2)
    got = folds.collect()
    assert sorted(r["rows"] for r in got) == [750, 750]
    assert all(r["cv_neg_mse"] <= 0 and r["cv_neg_mse_matched"] <= 0 for r in got)
    assert training.cross_validation_summary(folds).first()["mean_cv_score"] <= 0


def test_walks_of_any_number_of_rows():
    """Blocks of rows give what each row gives alone; a gap goes to the right, as a comparison with it does not hold."""
    draw = np.random.default_rng(5)
    left, right = np.array([1, 1, 3, 3, 4]), np.array([2, 1, 4, 3, 4])
    walker = forest_ops.Forest(("a", "b"), np.array([0, 0, 1, 0, 0]), np.array([0.0, 0.0, 0.5, 0.0, 0.0]), left, right,
                           np.array([0.0, 1.0, 0.0, 2.0, 3.0]), np.array([0]), 2, 1.0)
    x = draw.normal(size=(2 * forest_ops.WALK_ROWS + 3, 2))
    x[5, 0] = x[6, 1] = np.nan
    path = np.where(x[:, 0] <= 0, 1.0, np.where(x[:, 1] <= 0.5, 2.0, 3.0))
    assert (walker.score_matrix(x) == np.power(2.0, -path)).all() and len(walker.score_matrix(x[:0])) == 0
