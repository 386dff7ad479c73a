from __future__ import annotations

import math
import random

from lectern.llm import ball_tree as bt
from lectern.llm.catalog import op5_topk

SF = "/root/testdata/sf0.001"


def brute(vectors, k=5):
    """{query: [(vec_id, score)]} over {vec_id: whole-numbered vector}."""
    out = {}
    for q in (i for i in vectors if i % 50 == 0):
        scores = [(-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        if scores:
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def whole(v):
    return [math.floor(256 * float(x)) for x in v]


def test_query_equals_brute_force(spark, sf):
    assert found(op5_topk(spark, SF).collect()) == brute({r.vec_id: whole(r.embedding) for r in sf("embeddings").collect()})


def test_many_shards_and_blocks_with_ties(spark):
    rng = random.Random(3)
    vectors = {i: [rng.randint(-2, 2) for _ in range(4)] for i in range(700)}
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id bigint, vector array<double>")
    asked = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    assert found(bt.top_k(rows, asked, shard_rows=90, block_queries=5).collect()) == brute(vectors)


def slow_rows(rows):
    """Row by row: (query_id, rank, vec_id, score) over (vec_id, vector) rows, repeated ids and all."""
    out = []
    for n, (q, v) in enumerate(rows):
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(rows) if m != n and i is not None and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)]
    return sorted(out)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [0.0, 1.0], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 0.0], 1), (6, [None, 1.0], 1), (None, [1.0, 1.0], 1),
            (7, [1.0, 1.0, 1.0], 1), (100, [], 1), (8, [-1.0, -1.0], 1), (1, [0.5, 0.0], 1), (1, [0.9, 0.0], 1), (1, [0.9, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int").selectExpr("*", "1 as row", "2 as own", "3 as ask")
    able = [(i, whole(v)) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    able = [(i, [math.floor(256 * 0.8999999761581421) if x == 230 else x for x in v]) for i, v in able]
    assert sorted(tuple(r) for r in bt.search_embeddings(table).collect()) == slow_rows(able)
    assert bt.search_embeddings(table.filter("false")).count() == 0
    assert bt.search_embeddings(table.filter("vec_id = 7")).count() == 0


def test_large_components_are_exact(spark):
    vectors = [(0, [2.0**60, 1.0]), (1, [4.0, 3.0]), (2, [4.0, 2.0]), (3, [2.0**60, 0.0]), (4, [-(2.0**60), 0.0])]
    rows = spark.createDataFrame(vectors, "vec_id bigint, vector array<double>")
    got = bt.top_k(rows, rows.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 3, 2**63 - 1), (2, 1, 2**62 + 3), (3, 2, 2**62 + 2), (4, 4, -(2**63))]
