"""Importance walks a tree again only where a shuffled value takes another way, with the same changes."""

import numpy as np
import pytest

from logprism.operators import forest as forest_ops
from logprism.operators.forest import Forest, average_path


def forest(x, trees, rng):
    parts = {c: [] for c in ("feature", "threshold", "left", "right", "path")}
    roots, levels, base = [], 0, 0
    for _ in range(trees):
        nodes = sorted(forest_ops._grow(x[rng.choice(len(x), min(64, len(x)), False)], 6, rng))
        roots.append(base)
        for _, feature, threshold, left, right, size, depth in nodes:
            for c, v in zip(parts, (max(feature, 0), threshold, base + left, base + right, depth + average_path([size])[0])):
                parts[c].append(v)
            levels = max(levels, depth)
        base += len(nodes)
    return Forest(tuple("abcdef"), *(np.array(parts[c]) for c in parts), np.array(roots), levels, float(average_path([64])[0]))


@pytest.mark.parametrize("rows", [0, 1, 70, 300])
def test_changes_are_those_of_whole_walks(monkeypatch, rows):
    monkeypatch.setattr(forest_ops, "WALK_ROWS", 40)
    rng = np.random.default_rng(rows)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[:, 4], x[:, 5] = x[:, 4] > 1.2, 7.0  # a flag, and a feature that never differs
    model = forest(x, 12, rng)
    x = x[:rows]
    x[:1, 0] = np.nan
    other = x[rng.permutation(rows)]
    before, wanted = model.score_matrix(x), []
    for i in range(6):
        changed = x.copy()
        changed[:, i] = other[:, i]
        wanted.append(np.abs(model.score_matrix(changed) - before).sum())
    got = model.shuffle_changes(x, other)
    assert np.allclose(got, wanted, rtol=1e-12, atol=1e-13) and got[5] == 0 and (rows < 70 or got[0] > 0)
