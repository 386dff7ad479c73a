from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import quality as q
from lectern.llm.catalog import op13_quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words, lines = WORD.findall(text or ""), [s for s in (text or "").split("\n") if WORD.search(s)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def base(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words


def test_query_counts_and_verdicts(spark, sf):
    texts = {r.doc_id: r.text for r in sf("documents").collect()}
    good = {r.doc_id: r.quality for r in sf("labels").collect()}
    rows = op13_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base(r) == slow(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.log_ratio >= q.THRESHOLD)
    kept = {r.doc_id: r.kept for r in rows if not r.base_failed}
    assert sum(kept[i] for i, g in good.items() if g and i in kept) > 0.9 * sum(1 for i, g in good.items() if g and i in kept)
    assert rows == op13_quality(spark, SF).collect()


def test_documents_that_no_label_names(spark):
    """Trained on the labels of three quarters of a larger table, held to those of the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    seen = labels.filter("pmod(doc_id, 4) <> 2")
    judged = q.judge_quality(docs, seen).join(labels.join(seen, "doc_id", "left_anti"), "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in judged if r.quality], [r.kept for r in judged if not r.quality]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.1 * len(bad) and bad


def test_edges(docs_of):
    loop = "one two three four\n"
    rows = [(1, None), (1, ""), (2, " \t\n\x0b\r"), (None, "a b c " * 3), (3, loop * 20), (3, loop * 20), (4, "😀é#* x|y <b> 5% & $"), (5, "a b c\x1cd"),
            (6, "w " * 200000), (7, " ".join(f"v{i}" for i in range(60))), (8, "x y z x y z w q"), (9, "\n\nq\n\nq\n \n")]
    docs = docs_of(rows).withColumns({"m": F.lit(1), "kept": F.lit("k"), "trusted": F.lit(0), "n_words": F.lit("n"), "log_ratio": F.lit("r"), "_good": F.lit(1)})
    labels = docs.sparkSession.createDataFrame([(7, 1, 0), (7, 1, 0), (None, 1, 0), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = q.judge_quality(docs, labels).collect()
    assert sorted((str(r.doc_id), base(r)) for r in got) == sorted((str(i), slow(t)) for i, t in rows)
    assert {r.doc_id for r in got if r.kept} == {7}
    assert q.judge_quality(docs.limit(0), labels).collect() == []
    untaught = q.judge_quality(docs, labels.limit(0)).collect()
    assert all(r.log_ratio is None and r.kept == (not r.base_failed) for r in untaught) and any(r.kept for r in untaught)


def test_no_python_in_the_plan(spark):
    plan = op13_quality(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_both_ways_to_the_trusted(spark, sf, monkeypatch, limit):
    monkeypatch.setattr(q, "BROADCAST_IDS", limit)
    docs = sf("documents").select("doc_id", "text")
    got = q._trusted(docs, sf("labels")).filter("trusted").select("doc_id").collect()
    want = {r.doc_id for r in sf("labels").filter("quality = 1").collect()}
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} & want
