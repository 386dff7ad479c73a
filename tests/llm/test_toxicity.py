from __future__ import annotations

import math

import numpy as np

from lectern.llm import toxicity as tx
from lectern.llm.catalog import op10_toxicity

SF = "/root/testdata/sf0.01"


def test_labelled_documents_are_told_apart(spark):
    got = {r.doc_id: r for r in op10_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r.severity <= 2 and 0 <= r.toxic_p <= 1 and r.rejected == (r.toxic_p >= tx.REJECT_FROM) for r in got.values())
    right = sum(got[i].rejected == (t == 1) for i, t in labels.items())
    assert right / len(labels) > 0.97


def test_held_out_documents_are_told_apart(spark):
    """Fit on the labels of half of the documents, tried on the others."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = tx.rate_documents(docs, labels.filter("doc_id % 2 = 0")).collect()
    truth = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    caught = [r.rejected for r in rows if truth.get(r.doc_id) == 1]
    blamed = [r.rejected for r in rows if truth.get(r.doc_id) == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(blamed) / len(blamed) < 0.02


def nll(w, th, rows, grades, importance):
    out = 0.0
    for (b, s), g, i in zip(rows, grades, importance):
        x = sum(w.get(k, 0.0) * v for k, v in zip(b, s))
        edge = lambda t: 1 / (1 + math.exp(-(t - x)))
        out -= i * math.log((edge(th[g]) if g < len(th) else 1.0) - (edge(th[g - 1]) if g else 0.0))
    return out


def test_fit_orders_grades_and_lowers_the_likelihoods_loss():
    rng = np.random.default_rng(1)
    grades = np.repeat([0, 1, 2], 60)
    buckets = [np.array([5, 7 + int(rng.integers(40)), 99], dtype="int32") for _ in grades]
    shares = [np.array([0.4 * g + 0.05 * rng.random(), 1.0, 0.5], dtype="float32") for g in grades]
    model = tx.fit_ordinal(buckets, shares, grades, {0: 600, 1: 60, 2: 60})
    assert model.thresholds[0] < model.thresholds[1]
    scores = np.array([float(s @ model.weights[b]) / tx.SCALE for b, s in zip(buckets, shares)])
    assert scores[:60].max() < scores[60:120].min() and scores[60:120].max() < scores[120:].min()
    above = model.above(scores)
    assert (above[:, 0] >= above[:, 1]).all()
    importance = np.array([600, 60, 60])[grades] / np.array([60, 60, 60])[grades]
    importance /= importance.sum()
    w = {k: float(model.weights[k]) / tx.SCALE for b in buckets for k in b.tolist()}
    pairs = list(zip(buckets, shares))
    fitted = nll(w, model.thresholds, pairs, grades, importance)
    start = nll({}, -np.log([120 / 600, 60 / 660]), pairs, grades, importance)
    assert fitted < 0.5 * start


def test_edges(spark, docs_of):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, 0), (3, None, None), (None, 0, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    labels = labels.union(spark.createDataFrame([(100 + i, 1, 0) for i in range(20)], labels.schema))
    docs = docs_of([(100 + i, f"kind word number{i}") for i in range(20)] + [(1, "vile vile word"), (2, "kind word"), (3, None), (4, ""), (None, "vile"), (2, "kind word"), (5, "long " * 100_000)])
    got = tx.rate_documents(docs, labels)
    assert got.columns == ["doc_id", "severity", "grade", "toxic_p", "rejected"] and got.count() == 27
    assert {r.doc_id for r in got.filter("rejected").collect()} <= {1, None}
    assert [r.severity < 1e-9 for r in got.filter("doc_id in (3, 4)").collect()] == [True, True]
    nothing = tx.rate_documents(docs, labels.filter("false")).collect()
    assert not any(r.rejected for r in nothing) and len(nothing) == 27
    assert tx.rate_documents(docs_of([]), labels).count() == 0
    kept = tx.keep_civil(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 25
