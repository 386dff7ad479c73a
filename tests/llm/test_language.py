from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import language as lg
from lectern.llm.catalog import op3_language


def test_held_out_documents_are_named_right(spark, sf):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        got = {r.doc_id: r for r in op3_language(spark, folder).collect()}
        truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        assert set(got) == set(truth)
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
        held = [i for i, r in got.items() if r.held_out]
        assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) >= 0.97
        assert all(0 <= r.score <= 1 for r in got.values())


def slow_vector(text):
    """The document vector itself: bound n-gram vectors, added one by one."""
    letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    s = f" {' '.join(letters.split())} "
    out = np.zeros(lg.DIMENSION)
    for i in range(len(s) - 2):
        g = np.ones(lg.DIMENSION)
        for k in range(3):
            g = g * np.roll(lg.letter_vector(ord(s[i + k])), 2 - k)
        out += g
    return out


def test_prediction_is_the_nearest_prototype_by_cosine(docs_of):
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "Ünter ß9x", "z", "ΑΒΓ abc"]
    model = {"a": slow_vector("the man and the sea"), "b": slow_vector("le monde et la mer"), "c": slow_vector("der mann und das meer")}
    model = {k: v / np.linalg.norm(v) for k, v in model.items()}
    got = {r.doc_id: r for r in lg.identify(docs_of(list(enumerate(texts))), model).select("doc_id", "_language.*").collect()}
    for i, text in enumerate(texts):
        v = slow_vector(text)
        cos = np.array([v @ model[k] for k in model]) / np.linalg.norm(v)
        assert got[i].lang_pred == list(model)[int(cos.argmax())]
        if cos.max() > 0:
            assert abs(got[i].score - cos.max() / cos.clip(0).sum()) < 1e-3


def test_prototypes_are_bundles(spark):
    rows = spark.createDataFrame([("ab cd", "x"), ("efg", "x"), ("hij", "y"), (None, "y"), ("k", None), ("", "z"), ("12", "z")], "text string, lang string")
    model = lg.prototypes(rows)
    want = slow_vector("ab cd") / 5 + slow_vector("efg") / 3
    assert sorted(model) == ["x", "y"] and np.allclose(model["x"], want / np.linalg.norm(want), atol=1e-4)


def test_edges(docs_of):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 !?", "en", "s"), (4, "abc", "en", "s"), (None, "abc abd", "fr", "s"), (5, "lettres " * 300_000, None, "s")]
    got = {r.doc_id: r for r in lg.identify_held_out(docs_of(rows)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[5].lang_pred in ("en", "fr") and len(got) == 6
    empty = docs_of([])
    assert lg.identify_held_out(empty).count() == 0
    assert [tuple(r) for r in lg.identify(docs_of([(1, "abc")]), {}).select("_language.*").collect()] == [("und", 0.0)]
    assert lg.identify_held_out(docs_of(rows).filter(F.lit(True))).columns == ["doc_id", "held_out", "lang_pred", "score"]
