"""Hard negatives against all pairs, and the parts of the search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import hard_negatives
from tests.llm.conftest import SF


def by_force(rows):
    kept = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        one = (label, [math.floor(256 * x) for x in vector])
        kept[vec_id] = min(kept.get(vec_id, one), one)
    ids = sorted(kept)
    width = max((len(v) for _, v in kept.values()), default=0)
    vectors = np.array([kept[i][1] + [0] * (width - len(kept[i][1])) for i in ids], dtype=object).reshape(len(ids), width)
    out = set()
    for a in ids:
        if a % 50:
            continue
        scores = vectors @ vectors[ids.index(a)] if width else [0] * len(ids)
        order = sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k]))
        for p in [k for k in order if kept[ids[k]][0] == kept[a][0] and ids[k] != a][:5]:
            fit = [k for k in order if kept[ids[k]][0] != kept[a][0] and 50 * scores[p] <= 100 * scores[k] <= 95 * scores[p]]
            out |= {(a, ids[p], r, ids[k], int(scores[p]), int(scores[k])) for r, k in enumerate(fit[:3], 1)}
    return out


def mined(spark, rows, block=hard_negatives.BLOCK):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    df = df.withColumns({name: F.lit(f"<{name}>") for name in ("block", "query", "vector", "low", "high", "rank", "slab", "tile")})
    got = list(map(tuple, hard_negatives.mined(df, block).collect()))
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [hard_negatives.BLOCK, 40])
def test_given_vectors(spark, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    want = by_force(rows)
    assert len(want) > 50
    assert mined(spark, rows, block) == want


def test_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-2, 3, 6) / 4).tolist()) for i in range(600)]
    rows += [(i, i % 2, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(600, 1100)]  # one very common vector
    rows += [(1200, None, [1.0]), (1250, 1, None), (1300, 1, [float("nan")] * 6), (1301, 1, [None, 1.0]), (None, 1, [1.0] * 6), (1350, 1, []), (1351, 1, [0.5]), (1400, 2, [float("inf")])]
    rows += [rows[0], rows[50], (100, 2, [9.0] * 6), (1450, 1, [0.0] * 6), (-50, 1, [0.25] * 6), (1500, 77, [1.0] * 6)]
    assert mined(spark, rows, 64) == by_force(rows)


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.integers(1, 9, 4) * 65536.0 * 4).tolist()) for i in range(200)]
    assert mined(spark, rows, 50) == by_force(rows)


def test_no_rows(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(50, 1, [1.0])]) == set()
    assert mined(spark, [(50, 1, []), (51, 1, []), (52, 2, [])]) == by_force([(50, 1, []), (51, 1, []), (52, 2, [])])


def test_far_boxes_stay_closed(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.integers(0, 5, (2000, 8)) + 100 * k for k in range(4)])
    tree = hard_negatives.Tree(np.arange(len(vectors)), np.zeros(len(vectors), np.int64), vectors)
    opened = []
    real = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda q, r: opened.append(len(q) * len(r)) or real(q, r))
    some = vectors[::400]
    asked = {"vector": some, "label": np.zeros(len(some), np.int64), "anchor": np.full(len(some), -1)}
    asked |= {"low": np.full(len(some), hard_negatives.LEAST), "high": np.full(len(some), hard_negatives.MOST), "kth": np.full(len(some), hard_negatives.LEAST)}
    place, ids, scores = hard_negatives.search(tree, asked, 5, True)
    everything = some @ vectors.T
    for q in range(len(some)):
        order = sorted(range(len(vectors)), key=lambda i: (-everything[q, i], i))[:5]
        assert sorted(ids[place == q].tolist()) == sorted(order)
    assert sum(opened) < everything.size
