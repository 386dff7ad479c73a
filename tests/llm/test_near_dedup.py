from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import near_dedup as nd
from lectern.llm.components import components
from lectern.llm.catalog import op1_near_dedup

SF = "/root/testdata/sf0.001"


def slow_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(fps, distance):
    """{doc_id: smallest doc_id reachable} by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\né\x1c\xa0", max_size=40))
def test_simhash_is_the_majority_of_shingle_hashes(text):
    assert nd.simhash(text) == slow_simhash(text)


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: r for r in op1_near_dedup(spark, SF).collect()}
    fps = {r.doc_id: slow_simhash(r.text) for r in sf("documents").collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == brute(fps, 2)


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_links_of_hot_and_cold_buckets_lose_nothing(spark, distance):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(120)}
    for center in (0, rng.getrandbits(64)):  # near copies by the dozen, far beyond a pairwise bucket
        fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(150)}
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    found = components(nd.links(table, distance)).collect()
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    want = brute(dict(zip(range(len(fps)), fps)), distance)
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(want[i], set()).add(f)
    got = {}
    for f in fps:
        got.setdefault(root.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_links_that_no_bucket_pairs_are_right(spark):
    table = spark.createDataFrame([(1 << b,) for b in range(40)] + [(-1,)], "fp bigint")
    pairs = nd.links(table, 2).collect()
    assert all(bin((p.a ^ p.b) & (2**64 - 1)).count("1") <= 2 for p in pairs)


def test_thresholds_sum_and_cost():
    spent, chosen = nd.allocate([22, 21, 21], [1e3, 1e9, 1e3], [np.full(22, 0.5)] * 3, 1000, 2)
    assert sum(chosen) == 0 and chosen[1] == -1 and spent > 0
    counts = np.full((64, 64), 25.0)
    np.fill_diagonal(counts, 50)
    counts[3, 9] = counts[9, 3] = 50
    groups = nd.group_bits(counts, 100, 3)
    assert sorted(sum(groups, [])) == list(range(64)) and any({3, 9} <= set(g) for g in groups)


def test_defined_results_at_the_edges(docs_of):
    rows = [(5, None), (3, ""), (9, "a b"), (9, "a b"), (7, "A\tB"), (None, "a b"), (1, "word " * 70_000)]
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in nd.near_duplicates(docs_of(rows)).collect())
    assert [g[2] for g in got] == [7, 1, 3, 3, 7, 7, 7] and got[2][1] == "0" * 16
    assert nd.near_duplicates(docs_of([])).count() == 0


def test_one_of_each_group_stays_whole(docs_of):
    rows = [(5, "x y z u v"), (3, "x y z u v"), (3, "x y z u v"), (8, "quite another text here"), (None, "x y z u v")]
    docs = docs_of(rows)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "8", "None"]
    assert nd.keep_one(docs_of([])).count() == 0


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (2000, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1300)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
