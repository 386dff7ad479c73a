"""Hand-worked fixtures and brute-force twins."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import blocks as B
from lectern.operators import cells, chunking, dense, embedding, evidence, filters, find, joins, layout, maintenance, reports, scan, spread, trees, windows
from lectern.plans import jobs
from lectern.schemas import BLOCKS
from lectern.sources import audit, files, logs, tables


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [
    ("a\r\nb\rc", "a\nb\nc"), ("über-\nmut", "übermut"), ("a-\nb-\nc", "ab-\nc"), ("x\n Page 3 of 9 \ny", "x\n\ny"),
    ("x\n\n\n\n\ny", "x\n\ny"), ("x  \t\ny ", "x\ny"), ("é", "é"), ("", ""), ("page 4", ""), ("Pages 4", "Pages 4"),
])
def test_normalize_text(spark, raw, want):
    assert one(spark, X.normalize_text(F.col("t")), t=raw) == want


def test_blanks_of_every_kind_and_of_none(spark, monkeypatch):
    """Runs and line ends of every blank, beside characters near them, as the plain patterns would have it; texts without any
    are not searched for runs."""
    near = [chr(ord(c) + d) for c in X.BLANKS for d in (-1, 0, 1)] + ["\x00", "\x7f", "é", "’", "—", "漢", "\U0001F600"]
    texts = [f"a{c}b{c}{d}c{c}\nd{c}{c}\n\ne {c}" for c in near for d in (" ", "", "\u00a0")] + ["plain words", "", " ", "a\n\n b \n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.regexp_replace("t", f"{X.BLANK}{X.BLANK}+|[{X.BLANK}&&[^ ]]", " ")
    ends = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"\r\n?", "\n"), r"(?mdU)[^\S\n]+$", ""), r"\n{3,}", "\n\n")
    rows = df.select("t", X.collapse_ws(F.col("t")).alias("got"), slow.alias("want"), X.normalize_text(F.col("t"), False).alias("norm"), X.strip(F.coalesce(ends, F.lit(""))).alias("ends")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and [r.norm for r in rows] == [r.ends for r in rows]
    monkeypatch.setattr(X, "BLANK", "(")  # no pattern at all, so a text that meets it fails
    assert df.filter("t = 'plain words'").select(X.collapse_ws(F.col("t")).alias("v")).first().v == "plain words"


def test_strip_reasoning_and_titles(spark):
    assert one(spark, X.strip_reasoning(F.col("t")), t="a<THINK>x\ny</plan>b</think>c<plan>d") == "abc"
    assert one(spark, X.title(F.col("t")), t="  \n ") is None
    assert one(spark, X.preview(F.col("t"), 10), t="abcdefghijkl") == "abcdefghij..."
    assert one(spark, X.preview(F.col("t"), 10), t="abc defghijkl") == "abc..."


def block_rows(spark, rows):
    return spark.createDataFrame(rows, "file_id string, idx int, kind string, text string, page int, level int, items array<string>, ocr boolean")


def test_section_path_jumps(spark):
    levels = [1, 3, 2, 3, 1]
    rows = [("d", i, "heading", "ABCDE"[i], None, level, None, None) for i, level in enumerate(levels)]
    for span in (1, 2, 4096):
        out = B.section_path(block_rows(spark, rows), span=span).orderBy("idx").collect()
        assert [r.section_path for r in out] == [["A"], ["A", "B"], ["A", "C"], ["A", "C", "D"], ["E"]]


def test_carry_page_reads_page_breaks(spark):
    rows = [("d", 0, "paragraph", "x", None, None, None, None), ("d", 1, "page_break", "Page 4", None, None, None, None),
            ("d", 2, "paragraph", "y", None, None, None, None), ("d", 3, "paragraph", "z", 9, None, None, None), ("d", 4, "list", "", None, None, ["a"], None)]
    for span in (2, 4096):
        assert [r.block_page for r in B.carry_page(block_rows(spark, rows), span=span).orderBy("idx").collect()] == [None, 4, 4, 9, 9]


def brute_spans(tokens, size, overlap):
    out, cursor = [], 0
    while cursor < len(tokens):
        end, total = cursor, 0
        while end < len(tokens) and (end == cursor or total + tokens[end] <= size):
            total += tokens[end]
            end += 1
        out.append((cursor, end))
        if end >= len(tokens):
            break
        back, used = end, 0
        while overlap > 0 and back > cursor and used < overlap:
            back -= 1
            used += tokens[back]
        cursor = back if cursor < back < end else end
    return out


def test_fold_spans_properties():
    rng = random.Random(3)
    for _ in range(300):
        tokens = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        size, overlap = rng.randint(10, 80), rng.randint(0, 9)
        spans = chunking.fold_spans(tokens, size, overlap)
        assert spans == brute_spans(tokens, size, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(tokens)
        for (a, b), (c, _) in zip(spans, spans[1:]):
            assert a < c <= b
        assert all(b - a == 1 or sum(tokens[a:b]) <= size for a, b in spans)


def test_chunk_documents_shapes(spark):
    docs = spark.createDataFrame(
        [("a", "# T\n\n--- Page 2 ---\n\npara one\n\n- x\n- y\n\n## S\n\n" + "word " * 60), ("b", ""), ("c", None)], "file_id string, text string")
    rows = chunking.chunk_documents(B.text_blocks(docs), size=40, overlap=4).orderBy("file_id", "seq").collect()
    mine = [r for r in rows if r.file_id == "a"]
    assert [r.seq for r in mine] == list(range(len(mine)))
    assert mine[0].text.startswith("# T\n\npara one\n\n- x\n- y\n\n## S")
    meta = mine[0].metadata
    assert (meta.page_start, meta.page_end, meta.block_start, meta.section_path, meta.layout_hint) == (2, 2, 0, ["T"], "mixed_list")
    assert mine[-1].metadata.section_path == ["T", "S"]
    assert [(r.text, r.metadata.source, r.seq) for r in rows if r.file_id in "bc"] == [("", "empty", 0)] * 2
    assert chunking.chunk_documents(B.text_blocks(docs), size=40, overlap=4).orderBy("file_id", "seq").collect() == rows


def test_fallback_to_paragraphs(spark):
    docs = spark.createDataFrame([("a", "x\n\ny", [])], f"file_id string, text string, blocks {chunking.BLOCKS}")
    row = chunking.chunk_documents(docs).first()
    assert (row.text, row.metadata.source, row.metadata.block_start) == ("x\n\ny", "chunker", None)


def brute_merge(ranges):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("span", [None, 7])
def test_merge_ranges_against_brute_force(spark, span):
    rng = random.Random(5)
    keyed = {k: [(s, s + rng.randint(0, 9)) for s in (rng.randint(0, 120) for _ in range(40))] for k in "abc"}
    rows = [(k, s, e) for k, rs in keyed.items() for s, e in rs]
    out = windows.merge_ranges(spark.createDataFrame(rows, "k string, start int, end int").repartition(7), ["k"], span=span).collect()
    for k, rs in keyed.items():
        assert sorted((r.start, r.end) for r in out if r.k == k) == brute_merge(rs)


def test_prefix_fold_and_salted_and_band_join(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "b", i, rng.randint(-5, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    out = spread.prefix_fold(df, ["k"], ["pos"], F.floor(F.col("pos") / 13), {"before": ("v", "sum"), "top": ("v", "max")}).collect()
    for r in out:
        prior = [v for k, p, v in rows if k == r.k and p < r.pos]
        assert r.before == sum(prior) and r.top == (max(prior) if prior else None)
    small = spark.createDataFrame([("hot", "x"), ("b", "y")], "k string, name string")
    assert spread.salted_join(df, small, ["k"], ["pos"], rows_per_cut=30).count() == 300
    ranges = spark.createDataFrame([("hot", 10, 99), ("b", 200, 100), ("b", 0, 30)], "k string, lo int, hi int")
    got = spread.band_join(df, ranges, ["k"], "pos", "lo", "hi", width=8).count()
    assert got == sum(1 for k, p, _ in rows if (k == "hot" and 10 <= p <= 99) or (k == "b" and 0 <= p <= 30))


@pytest.mark.parametrize("options", [{}, {"list_rows": 3}, {"broadcast_rows": 4, "list_rows": 2}, {"broadcast_rows": 1, "list_rows": 1}])
def test_fan_join_against_brute_force(spark, options):
    big = [(f"k{i % 3}", i) for i in range(40)] + [("alone", 99), (None, 98)]
    small = [("k0", q, None if q % 4 else "x") for q in range(25)] + [("k1", 0, "y"), ("k1", 0, "y"), ("k9", 5, "z"), (None, 6, "z")]
    got = spread.fan_join(spark.createDataFrame(big, "k string, n int"), spark.createDataFrame(small, "k string, q int, f string"), ["k"], ["n"], **options)
    assert got.columns == ["k", "n", "q", "f"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, n, q, f)) for k, n in big for j, q, f in small if k is not None and k == j)
    none = spread.fan_join(spark.createDataFrame(big, "k string, n int"), spark.createDataFrame([], "k string, q int"), ["k"], ["n"], **options)
    assert none.count() == 0


def test_scope_of_one_chat_is_made_in_many_tasks(spark):
    chunks = spark.range(0, 4000, 1, 4).select(F.lit("chat").alias("chat_id"), F.concat(F.lit("f"), F.col("id") % 9).alias("file_id"), F.col("id").alias("chunk_id"))
    q = spark.range(30).select(F.col("id").alias("query_id"), F.lit("chat").alias("chat_id"), F.lit(None).cast("array<string>").alias("file_ids"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = filters.scope_join(q, chunks).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in made) == 120_000 and max(r["count"] for r in made) <= 40_000


def test_members_of_one_chat_are_made_in_many_tasks(spark):
    links = spark.range(0, 4000, 1, 4).select(F.lit("chat").alias("chat_id"), F.concat(F.lit("f"), F.col("id")).alias("file_id"), F.col("id").alias("linked_ord"))
    text = F.lit(None).cast("string")
    turns = spark.range(30).select(F.col("id").alias("query_id"), F.lit("chat").alias("chat_id"), F.lit(None).cast("array<string>").alias("turn_doc_ids"),
                                   text.alias("focus_document_id"), (F.col("id") % 2 == 0).alias("doc_pane_open"), text.alias("selection_file_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = filters.resolve_scope(turns, links)[1].groupBy(F.spark_partition_id(), "role").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {role: sum(r["count"] for r in made if r.role == role) for role in ("scope", "secondary")} == {"scope": 60_000, "secondary": 15 * 3999}
    assert max(r["count"] for r in made) <= 20_000


def test_scan_patterns_are_found_once_a_text(spark):
    texts = [(1, "find alpha-7 in Berlin reports"), (1, "another text of the same number"), (2, "  so  "), (3, None), (None, "unnamed question about Paris")]
    q = spark.createDataFrame([(i, f"f{n}", t) for i, t in texts for n in range(6)] + [(2, "f0", "  so  ")], "query_id int, file_id string, text string")
    got = scan.scan_patterns(q)
    want = q.select("query_id", "file_id", F.posexplode(scan._patterns(F.col("text"), 6)).alias("pattern_no", "pattern"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "regexp" not in got._jdf.queryExecution().executedPlan().toString()  # no text is searched beside its files


def test_compare_windows_places_slices_without_their_texts(spark):
    chunks = spark.createDataFrame([("f", n, f"words of chunk {n} " * 30, n, n) for n in range(9)], "file_id string, seq int, text string, page_start int, page_end int")
    made = windows.compare_windows(spark.createDataFrame([("q", "f", 600)], "query_id string, file_id string, cap int"), chunks)
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines) if " Window [" in line]
    assert below and not any(re.search(r"\b(t|text)#\d+", line) for line in below)
    assert [(r.seq_start, r.seq_end, r.page_start) for r in made.orderBy("seq_start").collect()] == [(0, 2, 0), (3, 5, 3), (6, 8, 6)]


def test_exact_quantiles_of_one_range_of_values(spark):
    """All values of a group in one range of magnitudes, narrowed part by part; ties, negatives and single values too."""
    rng = random.Random(6)
    groups = {
        "near": [1 + i * 1e-9 for i in range(3000)], "tied": [5.0] * 500 + [5.0 + 1e-12 * i for i in range(400)], "below": [-7 - rng.random() * 1e-3 for _ in range(900)],
        "wide": [rng.lognormvariate(0, 20) for _ in range(700)], "one": [3.25], "zero": [0.0] * 9,
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("near", None)], "g string, v double").repartition(5)
    ranks = {"p50": spread.linear_rank(0.5), "p95": spread.linear_rank(0.95), "low": spread.nearest_low_rank(0.95)}
    out = {r.g: r for r in spread.exact_quantiles(df, ["g"], "v", ranks, sort_rows=16, cuts=4).collect()}
    assert out.keys() == groups.keys()
    for g, vs in groups.items():
        assert out[g].p50 == pytest.approx(np.percentile(vs, 50), rel=1e-15, abs=0)
        assert out[g].p95 == pytest.approx(np.percentile(vs, 95), rel=1e-15, abs=0)
        assert out[g].low == sorted(vs)[int(0.95 * (len(vs) - 1))]
    everything = sorted(v for vs in groups.values() for v in vs)
    assert spread.exact_quantiles(df, [], "v", ranks, sort_rows=16, cuts=4).first().low == everything[int(0.95 * (len(everything) - 1))]
    assert spread.exact_quantiles(df.limit(0), ["g"], "v", ranks).count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(2)
    groups = {"a": [rng.uniform(-50, 50) for _ in range(101)], "b": [7.0] * 50, "c": [1.0, 2.0, 10.0], "d": [0.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    out = spread.exact_quantiles(df, ["g"], "v", {"p50": spread.linear_rank(0.5), "p95": spread.linear_rank(0.95), "low": spread.nearest_low_rank(0.95)}).collect()
    for r in out:
        vs = sorted(groups[r.g])
        assert math.isclose(r.p50, np.percentile(vs, 50), abs_tol=1e-9) and math.isclose(r.p95, np.percentile(vs, 95), abs_tol=1e-9)
        assert r.low == vs[int(0.95 * (len(vs) - 1))]
    assert len(out) == 4


def brute_anchors(hits, radius, limit=8):
    chosen = []
    for _, _, seq in sorted((-s, c, q) for s, c, q in hits):
        if len(chosen) < limit and all(abs(seq - c) >= 2 * radius + 1 for c in chosen):
            chosen.append(seq)
    return chosen


def test_diverse_anchors_against_brute_force(spark):
    rng = random.Random(8)
    hits = [(1, f"f{i % 3}", f"c{i:03d}", rng.randint(0, 60), rng.choice([0.1, 0.5, 0.9])) for i in range(120)]
    df = spark.createDataFrame(hits, "query_id int, file_id string, chunk_id string, seq int, score double")
    got = windows.diverse_anchors(df, 2).orderBy("file_id", "anchor_pos").collect()
    for f in ("f0", "f1", "f2"):
        assert [r.seq for r in got if r.file_id == f] == brute_anchors([(h[4], h[2], h[3]) for h in hits if h[1] == f], 2)


def test_budgeted_windows_shrink_cut_and_stop(spark):
    chunks = [(f"c{i}", "f", i, "x" * 400, 1 + i, 1 + i) for i in range(30)] + [("big", "g", 5, "y" * 9000, 3, 4)]
    cdf = spark.createDataFrame(chunks, "chunk_id string, file_id string, seq int, text string, page_start int, page_end int")
    hits = [(1, "f", "c10", 10, 0.9), (1, "f", "c20", 20, 0.8), (1, "f", "c11", 11, 0.7), (1, "g", "big", 5, 0.9)]
    hdf = spark.createDataFrame(hits, "query_id int, file_id string, chunk_id string, seq int, score double").withColumn("cap", F.lit(700))
    rows = windows.budgeted_windows(hdf, cdf, 2, "cap").orderBy("file_id", "seq_start").collect()
    # two ranges share 700 tokens: 350 each, so three 100-token chunks fit around 10 and around 20
    assert [(r.file_id, r.seq_start, r.seq_end) for r in rows] == [("f", 9, 11), ("f", 19, 21), ("g", 5, 5)]
    assert (rows[0].page_start, rows[0].page_end) == (10, 12)
    assert rows[2].text == "y" * 2800 + "\n… (truncated)"


def slow_scan(text, patterns, most, context, overview=True):
    """Windows of one document for one question, step by step: (line_start, line_end, neighbor) in order of place."""
    lines = text.split("\n")
    hits = []
    for p in patterns:
        for i, line in enumerate(lines, 1):
            if p in (line.lower() if p == p.lower() else line) and i not in hits:
                hits.append(i)
    ranges = []
    for n in sorted(hits[: 2 * most]):
        start, end = max(1, n - context), min(len(lines), n + context)
        if ranges and start <= ranges[-1][1] + 1:
            ranges[-1][1] = max(end, ranges[-1][1])
        else:
            ranges.append([start, end])
    body = lambda a, b: "\n".join(lines[a - 1 : b]).strip()
    kept = []
    for a, b in ranges:
        if t := body(a, b):
            k = sum(p.lower() in t.lower() for p in patterns)
            kept.append((-round(k + k / len(t.split("\n")), 6), a, b))
    best = sorted(kept)[:most]
    out, sides, seen = [(a, b, False) for _, a, b in best], [], set()
    for _, a, b in best if len(best) < most else []:
        for side, (x, y) in enumerate(((max(a - 2 * context, 1), a - 1), (b + 1, min(b + 2 * context, len(lines))))):
            if x <= y and y >= 1 and body(x, y) and (x, y) not in seen:
                seen.add((x, y))
                sides.append((side, x, y))
    near = [next((s for s in sides if s[0] == side), None) for side in (0, 1)]
    near = sorted((s for s in near if s), key=sides.index)
    out += [(x, y, True) for _, x, y in near][: most - len(best)]
    if not best and overview and body(1, max(60, 4 * context)):
        out = [(1, min(len(lines), max(60, 4 * context)), False)]
    return out


@pytest.mark.parametrize("per_row", [1, 256])
def test_scan_windows_against_brute_force(spark, monkeypatch, per_row):
    monkeypatch.setattr(scan, "ASKS_PER_ROW", per_row)
    rng = random.Random(5)
    words = ["alpha", "bravo", "charlie", "delta", "Echo", "filler", "filler", "filler", ""]
    docs = [(f"f{i}", "\n".join(" ".join(rng.choices(words, k=rng.choice([0, 1, 3]))) for _ in range(rng.choice([1, 5, 60, 200])))) for i in range(12)] + [("e", ""), ("n", None)]
    asks = [(q, f, t, m) for q, (t, m) in enumerate([("alpha", 1), ("bravo charlie", 3), ("delta alpha bravo", 10), ("nothing here", 2), ("echoes", 4)]) for f, _ in docs] + [(9, "gone", "alpha", 3), (8, "f1", "  ", 3)]
    q = spark.createDataFrame(asks, "query_id int, file_id string, text string, most int")
    df = spark.createDataFrame(docs, "file_id string, text string")
    for context in (2, 5):
        got = {}
        for r in scan.scan_windows(q, df, "most", context, per_pattern=None).orderBy("place").collect():
            got.setdefault((r.query_id, r.file_id), []).append((r.line_start, r.line_end, r.neighbor))
        texts = dict(docs)
        want = {(i, f): slow_scan(texts[f], [w for w in t.split() if len(w) > 4], m, context) for i, f, t, m in asks if texts.get(f) is not None}
        assert got == {k: v for k, v in want.items() if v}


def test_grep_takes_any_number_of_lines_and_patterns_as_they_are(spark):
    docs = spark.createDataFrame([("f", "\n".join(f"Line {i} a.b" for i in range(7000)))], "file_id string, text string")
    asked = [(1, "f", 0, "a.b"), (1, "f", 1, "line 6999"), (1, "f", 2, "LINE"), (1, "f", 3, " "), (2, "f", 0, "Line 1")]
    rows = scan.grep_lines(docs, spark.createDataFrame(asked, "query_id int, file_id string, pattern_no int, pattern string"))
    assert {(r.query_id, r.pattern_no): r["count"] for r in rows.groupBy("query_id", "pattern_no").count().collect()} == {(1, 0): 7000, (1, 1): 1, (2, 0): 1111}
    first = scan.grep_lines(docs, spark.createDataFrame([(1, "f", 0, "^line [0-9]+ A")], "query_id int, file_id string, pattern_no int, pattern string"), 3, regex=True)
    assert first.count() == 0
    with pytest.raises(ValueError):
        scan.grep_lines(docs, rows, 0)


def test_window_bytes_cut(spark):
    docs = spark.createDataFrame([("f", "\n".join(["é" * 1000] * 5)), ("g", " a \n\n"), ("h", "x" * 5000)], "file_id string, text string")
    texts = {r.file_id: r.text for r in scan.cap_window_bytes(docs, 1).collect()}
    assert texts == {"f": "\n".join(["é" * 1000] * 2 + ["… (truncated)"]), "g": "a", "h": "… (truncated)"}


def test_scanned_lines_meet_no_shuffle(spark):
    """What is exchanged for a scan is the documents and the questions, never a table of lines."""
    docs = spark.createDataFrame([("f", "a\nb")], "file_id string, text string")
    q = spark.createDataFrame([(1, "f", "alpha")], "query_id int, file_id string, text string")
    plan = scan.scan_windows(q, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") == 2 and "posexplode" not in plan and "Window" not in plan


@pytest.mark.parametrize("rows, queries", [(10, 7), (1000, 1000)])
def test_vector_topk_blocks_do_not_change_results(spark, rows, queries):
    rng = np.random.default_rng(0)
    vecs = [(i, rng.standard_normal(8).tolist()) for i in range(60)] + [(100, [0.0] * 8), (101, []), (102, [1.0, 2.0])]
    df = spark.createDataFrame(vecs, "chunk_id int, vector array<double>")
    q = df.filter("chunk_id < 12").select(F.col("chunk_id").alias("query_id"), "vector")
    got = {(r.query_id, r.rank): r.chunk_id for r in dense.vector_topk(q, df, 5, rows_per_block=rows, queries_per_block=queries).collect()}
    for i in range(12):
        sims = sorted((-round(_cos(vecs[i][1], v), 6) + 0.0, c) for c, v in vecs)[:5]
        assert [got[(i, r)] for r in range(1, 6)] == [c for _, c in sims]


def _cos(a, b):
    if not a or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_approximate_candidates_recall(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 16))
    vecs = [(i, (centers[i % 40] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(800)]
    df = spark.createDataFrame(vecs, "chunk_id int, vector array<double>")
    q = df.filter("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    known = cells.fit_cells(df)
    exact = {(r.query_id, r.chunk_id) for r in dense.vector_topk(q, df, 5).collect()}
    near = {(r.query_id, r.chunk_id) for r in dense.vector_topk(q, df, 5, approx=True, centroids=known, probes=4).collect()}
    assert len(exact & near) / len(exact) > 0.95
    counted = {r.query_id: r.candidates for r in cells.looked_at(q, df, known, 4).collect()}
    assert len(counted) == 160 and sum(counted.values()) < 0.2 * 160 * 800


def test_every_row_with_a_direction_has_one_cell(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 340)]
    odd = [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7)]
    other = [(500, [1.0, 2.0]), (501, [2.0, 1.0])]
    df = spark.createDataFrame(rows + odd + other, "chunk_id int, vector array<double>")
    known = cells.fit_cells(df.filter("chunk_id < 500"))
    placed = cells.in_cells(df, known).collect()
    assert sorted(r.chunk_id for r in placed) == [*range(340), 500, 501]
    assert len({r._cell for r in placed if 300 <= r.chunk_id < 340}) == 1
    # all cells probed: the same hits as the search of all rows, ties and lengths the sample did not hold included
    q = df.filter("chunk_id in (3, 300, 500, 401, 402)").select(F.col("chunk_id").alias("query_id"), "vector")
    near = dense.vector_topk(q, df, 5, approx=True, centroids=known, probes=10_000).collect()
    exact = {(r.query_id, r.chunk_id, r.score) for r in dense.vector_topk(q, df.filter("chunk_id < 400 or chunk_id >= 500"), 5).collect()}
    want = {e for e in exact if e[0] in (3, 300)} | {e for e in exact if e[0] == 500 and e[1] >= 500}
    assert {(r.query_id, r.chunk_id, r.score) for r in near} == want
    none = df.filter("false")
    assert cells.fit_cells(none) == {} and dense.vector_topk(q, none, 5, approx=True).count() == 0


def test_embedder_contract(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("a b",)], "text string")
    rows = [r.vector for r in embedding.embed(df, factory=embedding.hashed_bag(16)).collect()]
    assert rows[0] == rows[3] and abs(sum(x * x for x in rows[0]) - 1) < 1e-5 and not any(rows[1])
    with pytest.raises(Exception, match="gave 0 vectors"):
        embedding.embed(df, factory=lambda: lambda texts: np.zeros((0, 4))).collect()


def test_find_literal_edges(spark):
    texts = ["aAaa ßa.b*c \\E x", "no", "Über über ÜBER_ über"]
    blocks = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file_id string, block_index int, text string")

    def run(needle, **kw):
        q = spark.createDataFrame([(1, "f", needle)], "query_id int, file_id string, needle string")
        return [(r.block_index, r.start, r.end) for r in find.find_literal(q, blocks, **kw).orderBy("match_no").collect()]

    assert run("aa") == [(0, 0, 2), (0, 2, 4)]
    assert run("aa", case_sensitive=True) == [(0, 2, 4)]
    assert run("a.b*c") == [(0, 6, 11)]
    assert run("\\E") == [(0, 12, 14)]
    assert run("über", whole_word=True) == [(2, 0, 4), (2, 5, 9), (2, 16, 20)]
    assert run("a", limit=1) == [(0, 0, 1)]
    assert run("  ") == []


def test_find_without_a_limit_returns_every_match(spark):
    blocks = spark.createDataFrame([("f", 0, "ab x " * 1500), ("f", 1, "ab\u0301 ab")], "file_id string, block_index int, text string")
    q = spark.createDataFrame([(1, "f", "ab")], "query_id int, file_id string, needle string")
    for word in (False, True):
        got = find.find_literal(q, blocks, limit=None, whole_word=word).orderBy("match_no").collect()
        assert [(r.match_no, r.block_index, r.start) for r in got] == [(i + 1, 0, 5 * i) for i in range(1500)] + [(1501, 1, 0), (1502, 1, 4)]


DOC = '{"type":"doc","content":[{"type":"heading","attrs":{"level":9},"content":[{"type":"text","text":"Hi"}]},' \
      '{"type":"paragraph","content":[{"type":"text","text":"ab"},{"type":"hardBreak"},{"type":"text","text":"cd"}]},' \
      '{"type":"orderedList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"one"}]}]}]}]}'


def test_tree_blocks_and_positions(spark):
    df = spark.createDataFrame([("f", DOC), ("g", "broken")], "file_id string, doc string")
    blocks = {r.file_id: r.blocks for r in trees.tree_to_blocks(df).collect()}
    assert blocks["g"] == []
    assert [(b.kind, b.text, b.metadata.level) for b in blocks["f"]] == [("heading", "Hi", 6), ("paragraph", "ab\ncd", None), ("list", "one", None)]
    runs = trees.tree_text_runs(df, ["file_id"]).orderBy("block_index", "run_no").collect()
    # heading opens at 0, its text at 1; the paragraph opens at 4; the list at 11, its item 12, its paragraph 13
    assert [(r.block_index, r.run_no, r.run_at, r.pos, r.text) for r in runs] == [
        (0, 0, 0, 1, "Hi"), (1, 0, 0, 5, "ab"), (1, 1, 2, 7, "\n"), (1, 2, 3, 8, "cd"), (2, 0, 0, 14, "one")]
    all_runs = trees.tree_text_runs(df, ["file_id"])
    q = spark.createDataFrame([(1, "f", "b\nc")], "query_id int, file_id string, needle string")
    hit = find.to_positions(find.find_literal(q, trees.run_blocks(all_runs, ["file_id"])), all_runs).first()
    assert (hit.start, hit.end, hit.from_pos, hit.to_pos) == (1, 4, 6, 9)


def test_size_limits_are_arguments(spark):
    df = spark.createDataFrame([("a.txt", 20 << 20), ("a.exe", 20 << 20), ("b.txt", 60 << 20), ("c.exe", 5), ("d", None)], "filename string, size_bytes long")
    policies = lambda **limits: [r.policy for r in filters.classify_file_size(df, **limits).collect()]
    assert policies() == ["raw_large", "rejected", "rejected", "ingest", "ingest"]
    assert policies(most_bytes=None, large_suffixes=None) == ["raw_large", "raw_large", "raw_large", "ingest", "ingest"]
    assert policies(ingest_bytes=None, most_bytes=None) == ["ingest"] * 5
    assert policies(ingest_bytes=1, most_bytes=6, large_suffixes=(".exe",)) == ["rejected", "rejected", "rejected", "raw_large", "ingest"]


def test_find_in_what_chats_show(spark):
    meta = (None, None, None, None, None)
    documents = spark.createDataFrame([
        ("c", "f", "page", DOC, None, None), ("c2", "f", "blocks", None, [("paragraph", "x ab", meta), ("paragraph", "ab", meta)], "x ab"),
        ("c", "g", "chunks", None, None, "first\n\nthe ab"), ("c", "h", "none", None, None, None)],
        f"chat_id string, file_id string, origin string, doc string, blocks {BLOCKS}, text string")
    q = spark.createDataFrame(
        [(1, "c", "f", "b\nc"), (2, "c2", "f", "ab"), (3, "c", "g", "ab"), (4, "c", "h", "ab"), (5, "c9", "f", "ab"), (6, "c", "f", "ab")],
        "query_id int, chat_id string, file_id string, needle string")
    rows = jobs.find_in_chats(q, documents).orderBy("query_id", "match_no").collect()
    assert [(r.query_id, r.origin, r.block_index, r.start, r.end, r.from_pos, r.to_pos) for r in rows] == [
        (1, "page", 1, 1, 4, 6, 9), (2, "blocks", 0, 2, 4, 3, 5), (2, "blocks", 1, 0, 2, 7, 9), (3, "chunks", 1, 4, 6, 12, 14), (6, "page", 1, 0, 2, 5, 7)]


SPAN = "doc_id string, page int, block int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, " \
       "lines array<string>, max_size double, median_size double, bold_ratio double"


def span(block, x0, y0, x1, y1, lines, size=10.0, bold=0.0):
    return ("d", 1, block, x0, y0, x1, y1, 600.0, 800.0, lines, size, 10.0, bold)


def test_layout_order_headings_and_lists(spark):
    rows = [
        span(0, 50.0, 20.0, 550.0, 40.0, ["A Wide Title"], 18.0, 1.0), span(1, 320.0, 100.0, 560.0, 200.0, ["right one"]), span(2, 40.0, 300.0, 280.0, 400.0, ["left two"]),
        span(3, 40.0, 100.0, 280.0, 200.0, ["left one"]), span(4, 290.0, 770.0, 310.0, 790.0, ["Page 7"]),
        span(5, 320.0, 300.0, 560.0, 310.0, ["- a"]), span(6, 320.0, 312.0, 560.0, 330.0, ["- b", "2) c"]), span(7, 320.0, 400.0, 560.0, 420.0, ["x | y", "1 | 2"]),
        span(8, 320.0, 500.0, 560.0, 520.0, ["2.1 Numbered part"], 12.0, 1.0),
    ]
    ordered = layout.reading_order(spark.createDataFrame(rows, SPAN))
    assert [r.block for r in ordered.orderBy("reading_pos").collect()] == [0, 3, 2, 1, 5, 6, 7, 8]
    scored = layout.score_headings(ordered)
    levels = {r.block: r.heading_level for r in scored.collect()}
    # block 0: size +3, bold +2, position +0.5; block 8: size +1, bold +2, gap +2, number +0.5 and depth 1
    assert levels[0] == 1 and levels[8] == 3 and levels[3] is None
    kinds = [(r.kind, r.text) for r in layout.classify_layout_blocks(scored).orderBy("reading_pos").collect()]
    assert kinds == [("heading", "A Wide Title"), ("paragraph", "left one"), ("paragraph", "left two"), ("paragraph", "right one"), ("list", "a\nb\nc"),
                     ("code", "x | y\n1 | 2"), ("heading", "2.1 Numbered part")]
    outline = spark.createDataFrame([("d", 1, 2, "Left  One!"), ("d", 1, 5, "zzz")], "doc_id string, page int, level int, title string")
    assert {r.block: r.heading_level for r in layout.score_headings(ordered, outline).collect()} == levels | {3: 2}
    lonely = spark.createDataFrame([span(4, 290.0, 770.0, 310.0, 790.0, ["Page 7"])], SPAN)
    assert layout.drop_page_furniture(lonely).count() == 1


def test_extractors(spark):
    rows = [("a", "text/plain", b"x\xffy"), ("b", "application/json", b'{"k":[1]}'), ("c", "text/csv", b'a ,"b,c"\n1,2'),
            ("d", "text/html", b"<title>T</title><style>s</style><p>one<b>two</b><!--n--></p>"), ("e", "video/mp4", b"z"), ("f", "application/json", b"{bad")]
    df = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "file_id string, mime string, content binary")
    out = {r.file_id: r for r in files.extract(df).collect()}
    assert out["a"].text == "xy" and out["b"].text == '{\n  "k": [\n    1\n  ]\n}' and out["c"].text == "a, b,c\n1, 2"
    assert (out["d"].title, out["d"].text) == ("T", "T\none\ntwo") and out["e"].text == "z" and out["f"].text == "{bad"
    only = files.extract(df, {"text/*": files.per_file(lambda c: (c.decode("utf-8", "ignore"), None), "x")})
    assert only.filter("error like 'ExtractionError%'").count() == 3

    def boom(content):
        raise ValueError("no")

    assert files.extract(df, {"*": files.per_file(boom, "x")}).filter("error = 'ValueError: no'").count() == 6


def test_scan_files_and_logs(spark, folder):
    import pathlib

    base = pathlib.Path(folder)
    (base / "a.txt").write_text("hello")
    (base / "b.log").write_text("x")
    assert [(r.filename, r.size_bytes) for r in files.scan_files(spark, folder, "*.txt").collect()] == [("a.txt", 5)]
    good = base / "good.jsonl"
    good.write_text('{"id":"1","query":"q"}\n\n{"id":"2"}\n')
    assert [r.id for r in logs.read_jsonl(spark, str(good), "id string, query string").collect()] == ["1", "2"]
    for bad in ('{"id":', "[1]", "oops"):
        (base / "bad.jsonl").write_text('{"id":"1"}\n' + bad + "\n")
        with pytest.raises(Exception, match="bad JSON line"):
            logs.read_jsonl(spark, str(base / "bad.jsonl"), "id string, query string").collect()
    (base / "log.jsonl").write_text('{"id":"1","status":200}\n\nnope\n{"id":"2","status":500}\n')
    assert [r.id for r in logs.read_request_log(spark, str(base / "log.jsonl")).collect()] == ["1", "2"]


def test_sinks(spark, folder):
    rows = [("c1", [1.0, 2.0], "m", 1), ("c2", [1.0], "m", 1), ("c3", [1.0], "m", 2)]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<double>, embedding_model string, embedding_version int")
    dims = spark.createDataFrame([("m", 1, 2), ("m", 2, 1)], "embedding_model string, embedding_version int, dim int")
    bad = tables.write_vectors(df, dims, f"{folder}/v")
    assert [(r.chunk_id, r.error) for r in bad.collect()] == [("c2", "vector has 1 values, version expects 2")]
    back = spark.read.parquet(f"{folder}/v")
    assert {r.chunk_id for r in back.collect()} == {"c1", "c3"} and back.filter("embedding_version = 2").count() == 1
    report = spark.createDataFrame([(True, 0.5)], "ok boolean, score double")
    tables.write_report(report, f"{folder}/r")
    assert spark.read.json(f"{folder}/r").first().asDict() == {"ok": True, "score": 0.5}
    base = spark.createDataFrame([("a", "old", 1)], "id string, v string, created_at int")
    change = spark.createDataFrame([("a", "new", 9), ("b", "b", 9)], "id string, v string, created_at int")
    once = tables.upsert(base, change, ["id"])
    assert sorted(map(tuple, once.collect())) == [("a", "new", 1), ("b", "b", 9)] == sorted(map(tuple, tables.upsert(once, change, ["id"]).collect()))


def test_encryption_edges(spark):
    key = b"k" * 16
    df = spark.createDataFrame([("",), (None,), ("plain",), ("enc:v1:@@@",)], "t string")
    sealed = audit.encrypt_columns(df, ["t"], key)
    assert sealed.filter("t = 'plain'").count() == 0
    assert [r.t for r in audit.decrypt_columns(sealed, ["t"], key).collect()] == ["", "", "plain", ""]


def test_parse_messages_fallbacks(spark):
    rows = [('{"text":"hi","attachments":["a"],"activeVersionIndex":0,"versionSources":[[{"filename":"v"}]]}', '[{"filename":"c"}]'),
            ('"bare"', '[{"filename":"c"}]'), ("{broken", None), ("plain", "nope"), (None, None)]
    out = filters.parse_messages(spark.createDataFrame(rows, "content_json string, citations_json string")).collect()
    assert [r.text for r in out] == ["hi", "bare", "{broken", "plain", ""]
    assert [r.sources[0].filename if r.sources else None for r in out] == ["v", "c", None, None, None] and out[0].attachments == ["a"]


def test_smoke_evaluation(spark):
    rows = [("1", ["a"], ["a", "b"], "Alpha", "the alpha", 120.0), ("2", ["c"], ["c"], "beta", "BETA!", 135.0), ("3", ["d"], ["x", "d"], "g", "g", 155.0)]
    df = spark.createDataFrame(rows, "id string, relevant_doc_ids array<string>, retrieved_doc_ids array<string>, expected_snippet string, answer string, latency_ms double")
    r = reports.evaluate_retrieval(df, 5).first()
    assert (r.samples, r.hits_at_k, r.hit_rate_at_k, round(r.mrr_at_k, 4)) == (3, 3, 1.0, 0.8333)
    assert reports.evaluate_grounding(df).first().pass_rate == 1.0
    lat = reports.latency_summary(df, "latency_ms").first()
    assert (lat.p50_ms, lat.p95_ms, round(lat.mean_ms, 2)) == (135.0, 153.0, 136.67)
    empty = reports.latency_summary(df.limit(0), "latency_ms").first()
    assert (empty["count"], empty.p95_ms) == (0, 0.0)
    assert reports.evaluate_retrieval(df.limit(0), 5).first().samples == 0


def test_edits_branches_and_versions(spark):
    msgs = spark.createDataFrame([("m1", "c", "user", "a", 1, 0), ("m2", "c", "assistant", "b", 2, 1), ("m3", "c", "user", "d", 2, 2), ("n1", "e", "user", "z", 1, 0)],
                                 "message_id string, chat_id string, role string, text string, created_s bigint, pos bigint")
    edits = spark.createDataFrame([("c", "m1", "A"), ("c", "m2", "B"), ("x", "m3", "D"), ("e", "n1", " "), ("e", "nope", "t")], "chat_id string, message_id string, new_text string")
    new, rejected = maintenance.edit_message(msgs, edits)
    assert {(r.message_id, r.text) for r in new.collect()} == {("m1", "A"), ("n1", "z")}
    assert {r.reason for r in rejected.collect()} == {"only user messages can be edited", "message does not belong to chat", "content is required", "message not found"}


def test_index_repair_skips_blank_and_caps(spark):
    chunks = spark.createDataFrame([("f", f"c{i}", "t" if i else " ") for i in range(5)], "file_id string, chunk_id string, text string")
    vectors = spark.createDataFrame([("f", "c4", [1.0]), ("f", "zz", [1.0])], "file_id string, chunk_id string, vector array<float>")
    embed = lambda df: df.withColumn("vector", F.array(F.lit(0.5)).cast("array<float>"))
    fixed, report = joins.repair_index(chunks, vectors, embed, max_repairs=3)
    r = report.first()
    assert (r.missing, r.orphan, r.repaired, r.skipped, r.missing_after, r.orphan_after, r.ok) == (4, 1, 2, 1, 2, 1, False)
    assert {x.chunk_id for x in fixed.collect()} == {"c4", "zz", "c1", "c2"}


def test_context_pack_text(spark):
    q = spark.createDataFrame([(1, "Do it", "why?", " picked ", "s.txt", 4, "f.txt", None, None)],
                              "query_id int, task string, text string, selection_text string, selection_name string, selection_page int, focus_name string, pack string, pack_name string")
    hits = spark.createDataFrame([(1, 2, "b", "x.txt", None, 3, 5), (1, 1, " a ", None, 7, None, None)], "query_id int, pos int, text string, filename string, page int, page_start int, page_end int")
    memory = spark.createDataFrame([(1, 1, "m")], "query_id int, rank int, text string")
    scope = spark.createDataFrame([(1, 1, "g.txt"), (1, 2, "g.txt")], "query_id int, file_pos int, filename string")
    text = evidence.context_pack(q, hits, memory, scope).first().pack_text
    assert text.startswith("TASK:\nDo it\n\nUSER REQUEST:\nwhy?\n\nFILES IN SCOPE:\n- f.txt\n- g.txt\n\nSELECTED EXCERPT:\ns.txt (page 4)\npicked\n\n"
                           "DOCUMENT EVIDENCE:\n[E1] Document p7\na\n\n[E2] x.txt p3-5\nb\n\nLONG TERM MEMORY:\n[M1] m\n\nOUTPUT RULES:\n")


def test_empty_tables(spark):
    hits = spark.createDataFrame([], "query_id int, pos int, doc_id string, chunk_id string, text string, score double, filename string, page int, page_start int, page_end int")
    q = spark.createDataFrame([(1, 10)], "query_id int, budget int")
    assert evidence.budget_trim(hits, q).count() == 0 and evidence.citations(hits).count() == 0 and evidence.round_robin(hits, 3).count() == 0


def test_scan_sees_the_oldest_chunk_and_parts_of_words(spark):
    from lectern.operators import keyword

    rows = [(f"c{i:04d}", "f", i, "filler text") for i in range(1, 900)] + [("c0000", "f", 0, "Forgotten word-play, PLAYER play_2 ab")]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, created_ord int, text string")
    q = spark.createDataFrame([(1, "play forgotten"), (2, "ab"), (3, "absent play"), (4, "")], "query_id int, text string")
    got = {r.query_id: (r.chunk_id, r.score) for r in keyword.keyword_scan_topk(q, chunks, 5).collect()}
    assert got == {1: ("c0000", -4.0), 2: ("c0000", -1.0), 3: ("c0000", -3.0)}
    recent = keyword.keyword_scan_topk(q, chunks, 5, newest=100)
    assert recent.count() == 0


def test_keyword_scan_in_passes_and_scopes(spark, monkeypatch):
    """Several passes, kept rows handed out early, scopes of one chunk and of many, ties, repeated terms: as by counting."""
    from lectern.operators import keyword

    monkeypatch.setattr(keyword, "SCAN_QUESTIONS", 2)
    monkeypatch.setattr(keyword, "SCAN_ROWS", 7)
    monkeypatch.setattr(keyword, "SCAN_KEPT", 11)
    rng = random.Random(4)
    letters = ["ab", "abab", "aab", "b_a", "the", "theta", "a-b", "zz", "q9"]
    rows = [(f"c{i:03d}", f"f{min(i % 40, 5)}", i, " ".join(rng.choices(letters, k=rng.randrange(9))).upper() if i % 3 else "the " * (i % 5)) for i in range(150)] + [("n", "f1", 1, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, created_ord int, text string")
    asks = [(1, "the theta the"), (2, "ab"), (3, "zz q9 b_a"), (4, "nowhere"), (5, "ab"), (6, "aab abab"), (7, "!")]
    low = [(c, f, (t or "").lower()) for c, f, _, t in rows]

    def want(files=None):
        out = set()
        for i, text in asks:
            scored = sorted((-sum(t.count(w) for w in text.split()), c) for c, f, t in low if files is None or f in files[i])
            out |= {(i, c, float(s), r) for r, (s, c) in enumerate([x for x in scored if x[0] < 0][:5], 1)}
        return out

    q = spark.createDataFrame(asks, "query_id int, text string")
    got = keyword.keyword_scan_topk(q, chunks, 5)
    assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()} == want()
    files = {i: {f"f{i % 6}", "f5"} for i, _ in asks}
    scoped = spark.createDataFrame([(i, f, t) for i, t in asks for f in files[i]], "query_id int, file_id string, text string")
    got = keyword.keyword_scan_topk(scoped, chunks, 5, scope=["file_id"])
    assert {(r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect()} == want(files)
    assert keyword.keyword_scan_topk(q.limit(0), chunks, 5).count() == 0 and keyword.keyword_scan_topk(q, chunks.limit(0), 5).count() == 0


def test_bm25_keeps_to_the_file_before_the_limit(spark):
    from lectern.operators import keyword

    rows = [(f"o{i}", "other", "needle needle") for i in range(600)] + [("a1", "asked", "one needle in much longer text about other things")]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, text string")
    q = spark.createDataFrame([(1, "asked", "needle")], "query_id int, file_id string, text string")
    got = keyword.bm25_topk(q, keyword.build_term_index(chunks), 5, scope=["file_id"]).collect()
    assert [(r.chunk_id, r.rank) for r in got] == [("a1", 1)]


def test_ordinary_files_are_read_and_unknown_models_refused(spark):
    names = ["a.log", "b.rs", "c.yaml", "d.txt", "e.java", "f.md", "g.c", "h.ts", "noext"]
    rows = [(n, n, 5, f"text of {n}".encode()) for n in names]
    df = spark.createDataFrame(rows, "file_id string, filename string, size_bytes int, content binary")
    got = files.extract(files.detect_mime(df, "filename").select("file_id", "mime", "content")).collect()
    assert {r.file_id: r.text for r in got} == {n: f"text of {n}" for n in names}
    df = spark.createDataFrame([("x", "nobody")], "text string, embedding_model string")
    with pytest.raises(Exception, match="unknown embedding model"):
        embedding.embed_by_model(df, {"hashed-bag": embedding.hashed_bag()}).collect()


def test_storage_is_counted_below_the_base_only(spark):
    rows = [("file:/ws/uploads/ws/x", 1), ("file:///ws/cache/a", 2), ("file:/other/ws/logs/a", 4), ("/ws/misc", 8)]
    got = reports.storage_usage(spark.createDataFrame(rows, "path string, length bigint"), "/ws").collect()
    assert {r.component: r.bytes for r in got} == {"uploads": 1, "cache": 2, "other": 8}


def test_compaction_reads_every_message_of_a_long_chat(spark):
    """A summary that keeps what it looks for finds all of it, however the chat is cut; order and single parts hold."""
    keys = lambda c: F.concat(F.array_join(F.regexp_extract_all(c, F.lit("key[0-9]+"), F.lit(0)), " "), F.lit("."))
    rows = [("long", "user", i, f"message {i} " + "x" * (5000 if i % 100 == 0 else 3) + f" key{i}") for i in range(3000)] + [("short", "user", i, f"key{i}!") for i in range(6)]
    df = spark.createDataFrame(rows, "chat_id string, role string, pos int, text string").withColumn("message_id", F.concat("chat_id", F.lit("_"), "pos"))
    texts = {r.chat_id: r.text for r in maintenance.reduce_texts(df, keys, part_chars=60_000).collect()}
    assert texts["long"].split(".")[0].split() == [f"key{i}" for i in range(3000)] and texts["short"] == " ".join(f"key{i}" for i in range(6)) + "."
    kept, made = maintenance.compact(df, 10, keys, force=True)
    assert kept.count() == 8 and made.filter("chat_id = 'long'").first().text.split(".")[0].split() == [f"key{i}" for i in range(2996)]
    with pytest.raises(ValueError, match="shorter"):
        maintenance.reduce_texts(df, lambda c: c, part_chars=10).count()


def test_keyword_index_and_search_leave_postings_where_they_are(spark, monkeypatch):
    from lectern.operators import keyword

    texts = ["the a-b the", "", None, "Ünder the_a b", "zeta the a b the a"]
    chunks = spark.createDataFrame([(f"c{i}", "f", t) for i, t in enumerate(texts)], "chunk_id string, file_id string, text string")
    monkeypatch.setattr(keyword, "INDEX_WORDS", 2)
    index = keyword.build_term_index(chunks)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    want = {("the", "c0"): [0, 3], ("a", "c0"): [1], ("b", "c0"): [2], ("ünder", "c3"): [0], ("the", "c3"): [1], ("a", "c3"): [2], ("b", "c3"): [3],
            ("zeta", "c4"): [0], ("the", "c4"): [1, 4], ("a", "c4"): [2, 5], ("b", "c4"): [3]}
    rows = index.collect()
    assert {(r.term, r.chunk_id): r.positions for r in rows} == want and len(rows) == len(want)
    assert all(r.tf == len(r.positions) and r.doc_len == {"c0": 4, "c3": 4, "c4": 6}[r.chunk_id] for r in rows)
    q = spark.createDataFrame([(1, "the-a b2 the"), (2, "the the-a"), (3, "zeta the")], "query_id int, text string")
    found = []
    for most in (keyword.BROADCAST_ROWS, 0):
        monkeypatch.setattr(keyword, "BROADCAST_ROWS", most)
        found.append(sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in keyword.bm25_topk(q, index, 5).collect()))
    assert found[0] == found[1] and {(x[0], x[1]) for x in found[0]} == {(2, "c0"), (2, "c3"), (2, "c4"), (3, "c4")}


def test_readiness_counts_a_chat_once(spark):
    links = spark.createDataFrame([("a", f"f{i % 7}", i) for i in range(9)] + [("b", "f1", 1), (None, "f2", 1)], "chat_id string, file_id string, linked_ord int")
    states = ["completed", "failed", "queued", "processing", "completed"]
    known = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate(states)], "file_id string, status string")
    turns = spark.createDataFrame([
        (1, "a", ["f1", "none", "f9"], None, None, None, "all"), (2, "a", [], None, None, None, "ALL "), (3, "b", ["f1"], "f2", True, None, ""),
        (4, "b", [], None, None, None, "all"), (5, "c", ["f1"], None, None, None, "all"), (6, "c", [], None, None, None, "all"), (7, "a", [], None, None, "f4", "all"),
        (8, "a", [], None, None, None, ""), (9, None, ["f2"], None, None, None, "all"),
    ], "query_id int, chat_id string, turn_doc_ids array<string>, focus_document_id string, doc_pane_open boolean, selection_file_id string, doc_scope_mode string")
    want = filters.readiness_summary(filters.readiness(filters.required_files(turns, links), known, links))
    got = filters.readiness_by_turn(turns, known, links)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and got.count() == 8


def test_trees_are_listed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(trees, "TREES_AT_ONCE", 3)
    df = spark.createDataFrame([(f"f{i}", DOC if i % 4 else "broken") for i in range(11)], "file_id string, doc string").coalesce(1)
    blocks = {r.file_id: len(r.blocks) for r in trees.tree_to_blocks(df).collect()}
    assert blocks == {f"f{i}": 3 if i % 4 else 0 for i in range(11)}


def test_small_doc_pack_refuses_before_it_gathers(spark):
    files = spark.createDataFrame([(f"f{i}", f"n{i % 2}.txt") for i in range(4)], "file_id string, filename string")
    texts = spark.createDataFrame([("f0", " one "), ("f1", "two\n"), ("f2", "x" * 400), ("f3", " ")], "file_id string, plain_text string")
    asked = spark.createDataFrame([(1, "f0", 0), (1, "f1", 1), (2, "f0", 0), (2, "f2", 1), (3, "f3", 0), (4, "gone", 0), (5, "f2", 0)], "query_id int, file_id string, file_pos int")
    whole = {r.query_id: r for r in evidence.small_doc_pack(asked, files, texts).collect()}
    assert whole.keys() == {1, 2, 5} and whole[1].pack == "===== FILE: n0.txt =====\none\n\n===== FILE: n1.txt =====\ntwo"
    for q, r in whole.items():
        assert r.token_estimate == max(1, len(r.pack) // 4)
        for budget, fits in ((r.token_estimate, True), (r.token_estimate - 1, False)):
            got = {x.query_id: x.pack for x in evidence.small_doc_pack(asked, files, texts, budget).collect()}
            assert (q in got) == fits and got.items() <= {k: v.pack for k, v in whole.items()}.items()
    each = spark.createDataFrame([(1, 5), (2, 10_000)], "query_id int, budget int")
    assert {r.query_id for r in evidence.small_doc_pack(asked, files, texts, each).collect()} == {2}


def test_dense_cell_is_scored_in_slices(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(3)
    q = pd.DataFrame({"query_id": np.arange(11), "vector": [rng.integers(-2, 3, 3 + i % 2).astype(float) for i in range(11)]})
    c = pd.DataFrame({"chunk_id": rng.permutation(60), "vector": [rng.integers(-2, 3, 3 + i % 2).astype(float) for i in range(60)]})
    widest, best = [], dense._best
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(dense, "_best", lambda s, k: widest.append(len(s)) or best(s, k))
    got = dense._score_cell(7)(q, c)
    assert max(widest) == 4
    for i, v in enumerate(q["vector"]):
        unit = lambda x: x / (np.linalg.norm(x) or 1)
        points = [(-(round(float(unit(v) @ unit(w)), 6) + 0.0) if len(w) == len(v) else 0.0, n) for n, w in zip(c["chunk_id"], c["vector"])]
        mine = got[got["query_id"] == i]
        assert list(zip(mine["chunk_id"], mine["score"].round(6))) == [(n, -s + 0.0) for s, n in sorted(points)[:7]]


def test_memories_are_chosen_without_their_texts(spark):
    """Same text replaced, the newest kept, untouched chats whole; only rows that stay meet a window with their texts."""
    from lectern.operators.maintenance import save_memories

    cols = "memory_id string, chat_id string, type string, text string, created_at bigint"
    old = [(f"o{i}", "a", "summary", f"text {i}", 1000 + i) for i in range(12)] + [("z", "a", "summary", "never", 0), ("n", "a", "summary", "no time", None)]
    old += [("x", "b", "summary", "kept", 1), ("y", "b", "summary", "KEPT", 1)]
    new = [("f1", "a", "summary", " TEXT \n 11 "), ("f2", "a", "summary", " \n\t\xa0"), ("f3", "c", "summary", "w" * 1300)]
    out = save_memories(spark.createDataFrame(old, cols), spark.createDataFrame(new, "memory_id string, chat_id string, type string, text string"), 2000, keep=4, max_age_s=992)
    got = sorted((r.chat_id, r.memory_id, r.text, r.created_at) for r in out.collect())
    assert got == sorted([("a", "f1", "TEXT 11", 2000), *(("a", f"o{i}", f"text {i}", 1000 + i) for i in (10, 9, 8)), ("b", "x", "kept", 1), ("b", "y", "KEPT", 1), ("c", "f3", "w" * 1200, 2000)])
    assert "LeftSemi, BuildRight" in out._jdf.queryExecution().executedPlan().toString()


def test_only_texts_that_nfc_may_change_leave_the_jvm():
    """Composed letters need no Python; marks, singletons and Hangul parts do, and nothing that NFC changes is left out."""
    import re
    import unicodedata

    pattern = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08X}", X._unsettled()))
    assert not pattern.search("plain äöüñé – “text” 漢字 가")
    for changed in ("e\u0301", "\u212b", "\u1100\u1161", "\uac00\u11a8", "a\u0323\u0302", "\u09c7\u09be", "\U0001d15e"):
        assert pattern.search(changed)
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(chr(rng.choice((rng.randrange(0x20, 0xD800), rng.randrange(0x300, 0x370), rng.randrange(0xE000, 0x2FFFF)))) for _ in range(4))
        assert pattern.search(text) or unicodedata.normalize("NFC", text) == text


def test_extracted_texts_are_handed_on_in_parts(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(files, "OUT_CHARS", 10)
    batch = pd.DataFrame({"file_id": list("abcde"), "content": [b"1234567", b"1234567", b"", b"12345678901", b"x"]})
    parts = list(files.per_file(files._plain, "plain_text")(iter([batch])))
    assert [len(p) for p in parts] == [2, 2, 1] and "".join(t for p in parts for t in p["text"]) == "1234567" * 2 + "12345678901x"


def _peak_mb(run):
    """What ``run`` gives, and the most memory its Python objects held, in MB."""
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def test_chunking_holds_few_documents_as_python_objects():
    block = pa.struct([("title", pa.string()), ("level", pa.int32()), ("page", pa.int32())])
    rows = [[{"title": f"t{i}" if j % 3 == 0 else None, "level": 1 + j % 4, "page": j if j % 5 == 0 else None} for j in range(40)] for i in range(500)]
    rows[1:3] = [None, []]
    lists = pa.array(rows * 4, pa.list_(block)).slice(1)
    made, peak = _peak_mb(lambda: chunking.outlines(lists))
    assert made.slice(0, 499).to_pylist() == [chunking.open_headings(r) for r in rows[1:]] and len(made) == 1999
    assert peak < 8
    tokens = [[(i * j) % 9 for j in range(100)] for i in range(500)]
    tokens[1:3] = [None, []]
    spans, peak = _peak_mb(lambda: chunking.span_lists(pa.array(tokens * 4, pa.list_(pa.int32())).slice(1), 20, 5))
    assert spans.slice(0, 499).to_pylist() == [[{"start": a, "stop": b} for a, b in chunking.fold_spans(t or [], 20, 5)] for t in tokens[1:]]
    assert peak < 8


def test_embedding_holds_vectors_in_one_buffer():
    texts = [f"word{i} other{i % 7} Über" for i in range(3000)]
    texts[1:3] = [None, ""]
    model = embedding.HashedBag(256)
    model(["warm"])
    made, peak = _peak_mb(lambda: embedding.embed_texts(model, pa.array(texts)))
    bag = np.zeros(256)
    for token in ("word7", "other0", "über"):
        code = zlib.crc32(token.encode())
        bag[code % 256] += 1.0 if code & 0x80000000 else -1.0
    assert np.allclose(made[7].as_py(), bag / np.linalg.norm(bag))
    assert len(made) == 3000 and not any(made[1].as_py()) and made[1] == made[2]
    assert peak < 10  # their floats are 3 MB
    assert embedding.embed_texts(model, pa.array([], pa.string())).to_pylist() == []


def test_valid_plain_text_stays_in_the_jvm_and_the_rest_is_read_in_one_pass(spark):
    contents = {
        "plain": ("text/plain", "Übër\r\n\x00 ok".encode()), "bad": ("text/plain", b"a\xff\xc3b\xed\xa0\x80c"), "none": ("text/plain", None), "empty": ("image/x", b""),
        "xml": ("application/xml", b"<a>1</a>"), "html": ("text/html", b"<title>T</title><p>x</p>"), "json": ("application/json", b'{"a": 1}'), "csv": ("text/csv", b"a , b")}
    df = spark.createDataFrame([(k, m, c and bytearray(c)) for k, (m, c) in contents.items()], "file_id string, mime string, content binary")
    made = files.extract(df)
    out = {r.file_id: (r.text, r.title, r.method, r.error) for r in made.collect()}
    assert len(out) == made.count() == len(contents)
    for name in ("plain", "bad", "none", "empty", "xml"):
        assert out[name] == ((contents[name][1] or b"").decode("utf-8", "ignore"), None, "plain_text", None)
    assert out["html"] == ("T\nx", "T", "html_text", None) and out["json"][0] == '{\n  "a": 1\n}' and out["csv"][0] == "a, b"
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
