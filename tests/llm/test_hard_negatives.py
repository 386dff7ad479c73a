from __future__ import annotations

import math

import numpy as np
import pytest

from lectern.llm import hard_negatives as hn
from lectern.llm.catalog import op12_hard_negatives
from lectern.llm.vectors import products

SF = "/root/testdata/sf0.001"


def slow(rows):
    """(vec_id, embedding, label) to result rows, every pair scored."""
    able = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            able.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(float(np.float32(x)) * 256) for x in v]))
    out = []
    for n, i, label, v in able:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, other == label) for m, j, other, w in able if m != n and len(w) == len(v)]
        for p, pid, _, _ in sorted(s for s in scored if s[3])[:5]:
            fit = sorted((s, j, m) for s, j, m, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(i, pid, r, j, -p, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_against_brute_force(spark, sf):
    assert rows_of(op12_hard_negatives(spark, SF)) == slow([(r.vec_id, r.embedding, r.label) for r in sf("embeddings").collect()])


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr(
        "*", "1 as row", "'x' as vector", "2 as shard", "3 as norm", "array(1) as angles", "4 as want", "5 as block")


def test_clustered_rows_over_many_shards(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.1 * rng.normal(size=8)).tolist(), int(i % 4)) for i in range(1200)]
    rows += [(100, rows[100][1], 3), (7, rows[7][1], 1)] + [(5000 + i, [1.0] * 8, i % 2) for i in range(80)] + [(5100, [1.0] * 8, 0)] * 2
    got = rows_of(hn.mine(table_of(spark, rows), shard_rows=100))
    assert got == slow(rows) and len(got) > 100


def test_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (100, None, 1), (200, [1.0, None], 1), (300, [1.0, math.nan], 1), (400, [math.inf, 0.0], 1), (500, [1.0, 1.0], None),
            (None, [1.0, 1.0], 1), (600, [0.0, 0.0], 2), (1, [0.9, 0.5], 1), (2, [0.9, 0.4], 2), (3, [0.9, 0.4], 2), (4, [0.9, 0.4, 1.0], 2), (5, [-1.0, 0.0], 2),
            (700, [1.0, 0.0], 9), (8, [1.0, 0.0], 0), (9, [0.95, 0.1], 0), (10, [0.9, 0.0], 5), (800, [], 1), (11, [], 1)]
    docs = table_of(spark, rows)
    assert rows_of(hn.mine(docs)) == slow(rows)
    assert hn.mine(docs.limit(0)).collect() == [] and hn.mine(docs.filter("label is null")).collect() == []


def test_large_components_are_exact(spark):
    big = 2.0**40
    rows = [(0, [big, 1.0], 0), (1, [8.0, 3.0], 1), (2, [8.0, 2.0], 2), (3, [8.0, 2.5], 2), (4, [1.0, 1.0], 2)]
    assert len(slow(rows)) == 2 and rows_of(hn.mine(table_of(spark, rows))) == slow(rows)
    a, b = np.array([[2.0**60, 1.0]]), np.array([[4.0, 3.0], [2.0**60, 3.0], [-(2.0**60), 3.0]])
    assert products(a, b).tolist() == [[2**62 + 3, 2**63 - 1, -(2**63)]]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_bounds_hold_and_prune(spread):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 16)) * rng.uniform(1, 400, size=(8, 1))
    rows = np.concatenate([c + spread * np.abs(c).mean() * rng.normal(size=(64, 16)) for c in centers])
    anchors, refs = rows[::50], hn.references(rows)
    norms, turn = hn.angles(rows, refs)
    low, high = turn.reshape(8, 64, -1).min(axis=1), turn.reshape(8, 64, -1).max(axis=1)
    lower, upper = hn.bounds(*hn.angles(anchors, refs), low, high, norms.reshape(8, 64).min(axis=1), norms.reshape(8, 64).max(axis=1))
    scores = (anchors @ rows.T).reshape(len(anchors), 8, 64)
    assert (scores.min(axis=2) >= lower).all() and (scores.max(axis=2) <= upper).all()
    if spread < 1:  # tight windows rule each other out
        best = np.partition(scores.reshape(len(anchors), -1), -5)[:, -5]
        assert (upper >= best[:, None]).mean() < 0.5
