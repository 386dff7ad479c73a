from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lectern.llm import toxicity as tx
from lectern.llm.packing import CAPACITY
from test_mixture import water, words
from test_near_texts import slow_kept
from test_packing import ids_of
from test_pii import slow as slow_pii

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, sf, folder):
    docs = sf("documents")
    seen, rows = {}, docs.collect()
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == sf("documents").columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = (rows, docs.collect())
        rows = seen[name][1]

    before, after = seen["toxicity"]
    rejected = {r.doc_id for r in tx.rate_documents(sf("documents"), sf("labels")).filter("rejected").collect()}
    assert sorted(after) == sorted(r for r in before if r.doc_id not in rejected)
    labels = {r.doc_id: r.toxic for r in sf("labels").collect()}
    assert all(labels.get(r.doc_id) != 1 for r in after) and {i for i, t in labels.items() if t == 0} <= {r.doc_id for r in after}

    before, after = seen["near_dedup"]
    assert sorted((r.doc_id, r.text) for r in after) == sorted(slow_kept([(r.doc_id, r.text) for r in before]))

    before, after = seen["pii"]
    want = {r.doc_id: slow_pii(r.text, cp.PII_KEY)[0] for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)

    before, after = seen["mixture"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    target = water(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))})
    assert all(abs(taken[s] - target[s]) <= 20 for s in sizes)
    whole = {r.doc_id: r.text for r in before}
    assert all(whole[r.doc_id].startswith(r.text) for r in after)

    before, after = seen["packing"]
    assert sum(r.length for r in after) == sum(len(ids_of(r.text)) for r in before)
    filled = defaultdict(int)
    for r in after:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= CAPACITY


def test_stages_leave_columns_of_any_name_alone(spark, docs_of):
    taken = ["private", "private_kinds", "_found", "_seen", "_taken", "_text", "_private", "_size", "_slot", "_rate", "_words", "_toxicity", "found", "old",
             "seen", "taken", "slot", "rate", "words", "node", "root", "row", "doc", "mark", "bands", "c0", "c1"]
    docs = docs_of([(1, "call 415-555-2671 or a@b.example today, please do", "en", "a"), (2, None, "en", "a"), (3, "", None, None)])
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in taken})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in taken), name


def test_run_gives_pieces(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())
