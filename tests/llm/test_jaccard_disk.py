"""What the Jaccard join keeps on the disk: packed keys, one bitmap a class, meetings in rounds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from logprism.llm import jaccard
from logprism.llm.common import prepare


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    return prepare(spark)


def test_stars_of_packed_keys():
    def packed(rows):
        return pa.table([[1] * len(rows), [np.array(k, np.uint32).tobytes() for k, _ in rows],
                         [np.array(c, np.int64).tobytes() for _, c in rows]], schema=jaccard.PACKED)

    found = jaccard.stars_of(packed([([5, 5, 6, 8], [3, -2, 3, 9]), ([6, 5, 7, 9, 8], [4, 3, 1, 1, 9])])).to_pylist()
    assert {(r["class"], r["root"]) for r in found} == {(3, -2), (-2, -2), (3, 3), (4, 3)} and len(found) == 4
    assert jaccard.stars_of(packed([([5, 6], [3, 4])])).num_rows == 0


def test_keys_are_not_stored_and_tables_go(spark, monkeypatch):
    """Twelve bytes a first shingle are shuffled once; the stored tables are removed but for the documents' own."""
    draw, stored, gone = random.Random(2), [], []
    real, discard = jaccard.store, jaccard.discard
    monkeypatch.setattr(jaccard, "store", lambda df, label: stored.append(label) or real(df, label))
    monkeypatch.setattr(jaccard, "discard", lambda *tables: gone.extend(t.stored_at for t in tables) or discard(*tables))
    base = [f"w{draw.randrange(999)}" for _ in range(200)]
    rows = [(i, " ".join(draw.choice(["x", w]) if k % 97 == i % 97 else w for k, w in enumerate(base))) for i in range(30)]
    rows += [(100 + i, " ".join(f"v{draw.randrange(9999)}" for _ in range(200))) for i in range(10)]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(30)} == {0} and all(found[100 + i] == 100 + i for i in range(10))
    assert "prefixes" not in stored and len(gone) >= len(stored) - 1 and jaccard.MEETING_ROUNDS > 1
