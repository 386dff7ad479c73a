from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as cp
from lectern.llm import near_texts as nt
from lectern.llm.near_dedup import simhash


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_links(texts):
    sets = [slow_set(t) for t in texts]
    return {(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def slow_kept(rows):
    """Of each group of (doc_id, text) the first row by id, null last."""
    root = list(range(len(rows)))
    for i, j in sorted(slow_links([t for _, t in rows])):
        old, new = root[j], root[i]
        root = [new if r == old else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i])
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=str)


def changed(words, n, rng):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"other{rng.random()}"
    return " ".join(words)


def test_near_copies_beyond_two_bits_go(spark, docs_of):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (60, 100, 200, 400, 1000)]
    rows = [(10 * i + 1, " ".join(w)) for i, w in enumerate(base)]
    rows += [(10 * i + 2, changed(w, max(1, len(w) // 60), rng)) for i, w in enumerate(base)]  # similarity from 0.8 up
    rows += [(10 * i + 3, changed(w, len(w) // 5, rng)) for i, w in enumerate(base)]  # far below
    got = sorted(((r.doc_id, r.text) for r in cp.distinct(spark, docs_of(rows), "").collect()), key=str)
    assert got == slow_kept(rows) and len(got) == 10


def test_a_large_group_of_near_copies_becomes_one(docs_of):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, changed(words, 1, rng)) for i in range(150)] + [(1000 + i, f"text {i} of its own {rng.random()}") for i in range(50)]
    docs = docs_of(rows)
    got = nt.keep_distinct(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(1000, 1050)]


def test_rows_count_one_by_one(docs_of):
    """Repeated ids with unrelated texts lose none; copies without an id are reduced; no words are copies of each other."""
    rows = [(1, "a b c d e f"), (1, "quite another text than that"), (2, "A  b c d e f"), (None, "x y z u v"), (None, "x y z u v"), (None, "a b c d e f"), (7, None), (8, " ")]
    got = sorted(((r.doc_id, r.text) for r in nt.keep_distinct(docs_of(rows)).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "quite another text than that"), (None, "x y z u v"), (7, None)], key=str)
    assert nt.keep_distinct(docs_of([])).count() == 0


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.text) for r in cp.distinct(spark, docs, "").collect()), key=str)
    assert got == slow_kept(rows) and len(got) < len({t for _, t in rows})


def test_twins_among_boilerplate(docs_of):
    """230 texts that share most of their wording are no copies of each other; 40 of them have a twin just above 0.8."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(440)]

    def own(n):
        return [f"o{rng.random()}" for _ in range(n)]

    plain = [common + own(60) for _ in range(190)]
    twins = [common + own(60) for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(plain + twins)]
    rows += [(1000 + i, " ".join(w[:-55] + own(55))) for i, w in enumerate(twins)]
    rows += [(2000 + i, " ".join(w + ["end"])) for i, w in enumerate(plain[:3])]
    got = sorted(((r.doc_id, r.text) for r in nt.keep_distinct(docs_of(rows)).collect()), key=str)
    want = slow_kept(rows)
    assert got == want and len(rows) - len(want) >= 40


@pytest.mark.parametrize("few", [0, nt.BROADCAST_ROWS])
def test_large_buckets_of_several_groups(docs_of, monkeypatch, few):
    """Buckets of hundreds of texts: one group large enough for blocks of its own, chains, and sizes far apart."""
    monkeypatch.setattr(nt, "TILE", 16)
    monkeypatch.setattr(nt, "BROADCAST_ROWS", few)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(changed(common, 1, rng).split() + ["x"] * (i % 3))) for i in range(90)]
    tail = [f"t{i}" for i in range(70)]
    rows += [(1000 + i, " ".join(common + tail[: 5 * i])) for i in range(12)]
    rows += [(2000 + i, " ".join(common + [f"z{i}{k}" for k in range(52 + i % 4)])) for i in range(60)]
    rows += [(3000 + i, t + " more") for i, t in rows[-20:]]
    got = sorted(((r.doc_id, r.text) for r in nt.keep_distinct(docs_of(rows)).collect()), key=str)
    assert got == slow_kept(rows)


def test_overlaps_are_those_of_sets(monkeypatch):
    monkeypatch.setattr(nt, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 60, size=n)).astype("<u8") for n in sizes] for sizes in ((0, 5, 40, 90), (1, 30, 0)))
    assert nt.overlaps(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_fingerprints_find_close_copies(docs_of, monkeypatch):
    """With bands that tell every text apart, copies within two bits are still found, and the fingerprint is op1's over the set."""
    monkeypatch.setattr(nt, "_marks", lambda texts, made=nt._marks: made(texts).assign(bands=lambda d: [[n + i for i in range(nt.BANDS)] for n in d["node"]]))
    rng = random.Random(4)
    base = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join(base + ["end"])), (3, " ".join(changed(base, 1500, rng))), (4, "a b c"), (5, "A  b c")]
    assert bin((nt.fingerprint(nt.shingles(rows[0][1])) ^ nt.fingerprint(nt.shingles(rows[1][1]))) & (1 << 64) - 1).count("1") <= nt.DISTANCE
    assert sorted(r.doc_id for r in nt.keep_distinct(docs_of(rows)).collect()) == [1, 3, 4]
    text = " ".join(f"v{i}" for i in range(80))
    assert nt.fingerprint(nt.shingles(text)) & (1 << 64) - 1 == simhash(text, nt.WORDS)
