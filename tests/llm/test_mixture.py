from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixture as mx
from lectern.llm.catalog import op4_mixture

SF = "/root/testdata/sf0.001"


def water(sizes, weights, epochs=3.0):
    """Targets by taking the worst source out, one at a time."""
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = {s: weights[s] for s in sizes if s not in fixed}
        left = total - sum(fixed.values())
        if not sum(free.values()):
            return {s: fixed.get(s, 0.0) for s in sizes}
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] >= epochs * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: epochs * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, texts):
    """texts: [(source, text)]; every source near its target, every document within three of itself."""
    sizes, order = defaultdict(int), sorted({s for s, _ in texts if s is not None}) + [None] * any(s is None for s, _ in texts)
    for s, t in texts:
        sizes[s] += words(t)
    want = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken, slots = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        slots[r.source] += 1
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 + slots[s]


def test_query_meets_the_targets(spark, sf):
    rows = op4_mixture(spark, SF).collect()
    check(rows, [(r.source, r.text) for r in sf("documents").collect()])
    assert rows == op4_mixture(spark, SF).collect()


def test_edges(docs_of):
    rows = [(1, "a b c", "en", "é"), (1, "a b c", "en", "é"), (2, None, "en", "z"), (3, "", "en", "a"), (4, "w " * 5000, "en", None), (None, "x y", "en", "a"), (6, "k", "en", "ａ")]
    docs = docs_of(rows)
    got = mx.mix(docs).collect()
    check(got, [(r[3], r[1]) for r in rows])
    assert len(got) == 7 and mx.mix(docs_of([])).count() == 0


def test_weights_of_ones_own_and_clamping(spark, docs_of):
    docs = docs_of([(i, "w " * 10, "en", "big") for i in range(90)] + [(100 + i, "w " * 10, "en", "small") for i in range(10)])
    weights = spark.createDataFrame([("small", 9.0), ("big", 1.0)], "source string, weight double")
    got = {r.source: r.target for r in mx.mix(docs, weights).collect()}
    assert got == {"small": 300.0, "big": 700.0}
    only = spark.createDataFrame([("small", 1.0)], "source string, weight double")
    assert {r.source: r.target for r in mx.mix(docs, only).collect()} == {"small": 300.0, "big": 0.0}


def test_documents_are_repeated_as_often_as_taken(docs_of):
    rows = [(i, f" w{i}\ta  b c d ", "en", "abc"[i % 3]) for i in range(60)] + [(99, "", "en", "a"), (98, None, "en", "b")]
    docs = docs_of(rows)
    taken = {r.doc_id: r.taken for r in mx.mix(docs).collect()}
    out = mx.repeat_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += words(r.text)
        assert r.text is None or rows[r.doc_id if r.doc_id < 60 else 60][1].startswith(r.text) and r.n_chars == len(r.text)
    assert {i: got[i] for i in taken} == taken
    assert mx.repeat_documents(docs_of([])).count() == 0


def test_no_python_in_the_plan(sf):
    for df in (mx.mix(sf("documents")), mx.repeat_documents(sf("documents"))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_by_code_point_null_last(spark):
    names = ["ab", "a", "é", "ｚ", "𝒳", "Z", ""]
    got = mx.rank_sources(spark.createDataFrame([(n,) for n in [*names, None]], "source string")).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.place)] == [*sorted(names), None]
    assert sorted(r.place for r in got) == list(range(8))
    assert spark.range(1).select(mx.word_count(F.lit("\u00a0a\x0bb\x1cc ")).alias("n")).first().n == 2
