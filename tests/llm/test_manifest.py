from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import manifest as mf
from lectern.llm.catalog import op11_manifest

SF = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of a tree, and for each leaf its siblings level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            first = at - at % 3
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
            at //= 3
        paths.append(path)
    return levels, paths


def slow(rows):
    """rows of (doc_id, text, lang, source, n_chars) to the multiset of result rows."""
    trees = defaultdict(list)
    for i, t, lang, source, n in rows:
        own = slow_leaf(i, source, lang, n, t)
        cut = i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0
        trees[source].append((i, own, slow_leaf(i, source, lang, n, t.replace("\n", "")) if cut else own))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    built = {s: climb([r[1] for r in trees[s]]) for s in order}
    top, onward = climb([built[s][0][-1][0] for s in order])
    out = []
    for s, after in zip(order, onward):
        for (i, own, changed), path in zip(trees[s], built[s][1]):
            whole, node = path + after, changed
            for a, b in whole:
                node = h(a + node + b)
            root = top[-1][0]
            out.append((i, own, built[s][0][-1][0], root, h("".join(a + b for a, b in whole)), node, node == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in sf("documents").collect()]
    assert rows_of(op11_manifest(spark, SF)) == slow(docs)


def test_edges(docs_of):
    rows = [(1, "a\nb", "en", None), (1, "a\nb", "en", None), (None, "x\n", "en", "é"), (None, "x\n", None, "é"), (2, None, "en", "z"), (3, "", "en", ""),
            (4, "w\n" * 50000, "en", "ａ"), (-7, "k\n", "en", "z"), *((i, f"{i}\n", "en", "many") for i in range(100))]
    docs = docs_of(rows).withColumns({"place": F.lit("x"), "node": F.lit(1), "tree": F.lit("t"), "path": F.lit("p"), "leaf": F.lit(0)})
    assert rows_of(mf.prove_documents(docs)) == slow([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows])
    assert mf.prove_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_positions_are_those_of_the_log(n):
    height = mf.levels(n)
    nodes = [h(str(i)) for i in range(n)]
    log, (levels, paths) = mf.append(nodes, height), climb(nodes)
    seen = {mf.position(level, i, n): node for level, row in enumerate(levels) for i, node in enumerate(row)}
    assert [seen[i] for i in range(len(log))] == log and len(seen) == len(log)
    for i in range(n):
        assert mf.siblings(log, i, n, height) == paths[i]


def test_tiers_of_blocks_make_one_tree(spark):
    """Blocks of nine: three tiers give the roots, the positions and the proofs of one builder."""
    sizes = {"a": 1, "b": 9, "c": 10, "d": 83, "e": 700}
    entries = [(t, i, n, h(f"{t}{i}")) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(entries, "tree string, place bigint, n bigint, node string")
    log = mf.append_log(df, height=2)
    roots = {r.tree: r.root for r in mf.roots(log, height=2).collect()}
    nodes = defaultdict(dict)
    for r in mf.log_nodes(log, height=2).collect():
        assert r.position not in nodes[r.tree]
        nodes[r.tree][r.position] = (r.level, r.place, r.node)
    proofs = {(r.tree, r.place): [tuple(s) for s in r.path] for r in mf.prove(log, df.select("tree", "place"), height=2).collect()}
    assert len(proofs) == len(entries)
    for t, n in sizes.items():
        levels, paths = climb([h(f"{t}{i}") for i in range(n)])
        assert roots[t] == levels[-1][0]
        assert [nodes[t][i][2] for i in range(len(nodes[t]))] == mf.append(levels[0], mf.levels(n))
        assert all(levels[lv][p] == node for lv, p, node in nodes[t].values())
        assert [proofs[t, i] for i in range(n)] == paths


def test_places_of_hot_trees(spark):
    rows = [("hot", i // 3, f"{i % 3}") for i in range(300)] + [("one", 5, "x")] * 40
    got = mf.ranked(spark.createDataFrame(rows, "tree string, k int, node string").repartition(7), F.col("k")).collect()
    for tree, n in (("hot", 300), ("one", 40)):
        own = sorted((r.place, r.k, r.node) for r in got if r.tree == tree)
        assert [o[0] for o in own] == list(range(n)) and [o[1:] for o in own] == sorted(o[1:] for o in own)
        assert {r.n for r in got if r.tree == tree} == {n}
