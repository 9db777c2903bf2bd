import random

import pytest
from pyspark.sql import functions as F

from logprism.operators import ordered
from logprism.operators.windows import CountWhere, DistinctOf, rolling_count, rolling_distinct, trailing_windows

BASE = 1_704_067_200_000_000  # 2024-01-01
MINUTE = 60_000_000


def frame(spark, rows):
    """rows: (id, micros, key, hit, values)"""
    df = spark.createDataFrame(rows, "id long, us long, k string, hit boolean, vs array<string>")
    return df.withColumn("ts", F.timestamp_micros("us"))


def brute(rows, width, keyed=False):
    out = {}
    for i, t, k, _, _ in rows:
        if t is None:
            out[i] = (None, None)
            continue
        inside = [r for r in rows if r[1] is not None and t - width <= r[1] <= t and (not keyed or r[2] == k)]
        out[i] = (sum(bool(r[3]) for r in inside), len({v for r in inside for v in r[4] or [] if v is not None}))
    return out


def run(df, minutes, keys=()):
    measures = {"n": CountWhere(F.col("hit")), "d": DistinctOf(F.col("vs"))}
    got = trailing_windows(df, "ts", measures, minutes, keys).collect()
    return {w: {r["id"]: (r[f"{w}_n"], r[f"{w}_d"]) for r in got} for w in minutes}


def test_both_ends_count(spark):
    rows = [
        (0, BASE, "a", True, ["x"]),
        (1, BASE + 5 * MINUTE, "a", False, []),       # exactly w later: included
        (2, BASE + 5 * MINUTE + 1, "a", True, ["y"]),  # one microsecond too late
        (3, BASE + 5 * MINUTE + 1, "a", True, ["x"]),  # shares its instant with row 2
        (4, None, "a", True, ["z"]),
    ]
    got = run(frame(spark, rows), {"w": 5})["w"]
    assert got == {0: (1, 1), 1: (1, 1), 2: (2, 2), 3: (2, 2), 4: (None, None)}


@pytest.mark.parametrize("seed, span", [(1, 3 * 60 * MINUTE), (2, 20 * MINUTE), (3, 400)])
def test_random_logs_match_brute_force(spark, seed, span):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        t = BASE + (span // 2 if rng.random() < 0.33 else rng.randrange(span))  # a third shares one instant
        values = [rng.choice("abcdef") for _ in range(rng.randrange(3))] + ([None] if i % 40 == 0 else [])
        rows.append((i, t, rng.choice(["p", "q", None]), rng.random() < 0.4, values if i % 17 else None))
    widths = {"five": 5, "quarter": 15, "hour": 60}
    df = frame(spark, rows)
    for keyed in (False, True):
        got = run(df, widths, ["k"] if keyed else ())
        for name, minutes in widths.items():
            assert got[name] == brute(rows, minutes * MINUTE, keyed), (name, keyed)


def test_rows_on_block_edges(spark):
    edge = (BASE >> ordered.BLOCK_BITS) << ordered.BLOCK_BITS
    rows = [(i, edge + d, "a", True, [str(i % 2)])
            for i, d in enumerate((-1, 0, 1, (1 << ordered.BLOCK_BITS) - 1, 1 << ordered.BLOCK_BITS, 5 * MINUTE - 1, 5 * MINUTE, 5 * MINUTE + 1))]
    assert run(frame(spark, rows), {"w": 5})["w"] == brute(rows, 5 * MINUTE)


def test_dense_and_old_instants(spark):
    rows = [(i, -2_000 + i * 7, "a", i % 3 == 0, [str(i % 5)]) for i in range(600)]  # around 1970
    assert run(frame(spark, rows), {"w": 0.00005})["w"] == brute(rows, 3000)


def test_rolling_helpers(spark):
    rows = [(i, BASE + i * MINUTE, "ab"[i % 2], True, []) for i in range(10)]
    df = frame(spark, rows)
    counts = {r["id"]: r["n"] for r in rolling_count(df, "ts", F.lit(True), 4, "n", ["k"]).collect()}
    assert counts == {i: min(i // 2 + 1, 3) for i in range(10)}
    different = {r["id"]: r["n"] for r in rolling_distinct(df, "ts", "k", 4, "n").collect()}
    assert different == {i: 1 if i == 0 else 2 for i in range(10)}


def test_plan_has_no_cross_join_and_no_python(spark, sf_dir):
    from checks.views import logs
    from logprism.operators.windows import window_features

    plan = window_features(logs(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert "collect_" not in plan  # no list of the values of a window is ever held


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_running_sum_levels(spark, levels):
    rng = random.Random(levels)
    rows = [(k, a, rng.randrange(-5, 6)) for k in ("p", "q") for a in rng.sample(range(-(1 << 50), 1 << 50), 150)]
    got = ordered.running_sum(spark.createDataFrame(rows, "k string, a long, v long"), "a", ["v"], ["k"], levels=levels)
    want, total = {}, {}
    for k, a, v in sorted(rows):
        total[k] = total.get(k, 0) + v
        want[(k, a)] = total[k]
    assert {(r["k"], r["a"]): r["v"] for r in got.collect()} == want


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_neighbours(spark, levels):
    rng = random.Random(7)
    axis = sorted(rng.sample(range(1 << 50), 80)) + [(1 << 50) + i for i in range(40)]
    rows = [("p", a, i) for i, a in enumerate(axis)]
    got = ordered.neighbours(spark.createDataFrame(rows, "k string, a long, v long"), "a", "v", ["k"], levels)
    for r in got.collect():
        assert r["prev_value"] == (r["v"] - 1 if r["v"] else None)
        assert r["next_value"] == (r["v"] + 1 if r["v"] < len(axis) - 1 else None)


def test_ranged_running_sum(spark):
    rows = [(k, i / 7.0, i % 4) for k in ("p", "q") for i in range(500)]
    got = ordered.ranged_running_sum(spark.createDataFrame(rows, "k string, s double, n long"), "s", ["n"], ["k"])
    want, total = {}, {}
    for k, s, n in sorted(rows):
        total[k] = total.get(k, 0) + n
        want[(k, s)] = total[k]
    assert {(r["k"], r["s"]): r["cum_n"] for r in got.collect()} == want
    assert {r["total_n"] for r in got.collect()} == {total["p"]}
